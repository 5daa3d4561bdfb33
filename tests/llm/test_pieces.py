"""Models that the transducer does not compile."""

import pytest

from sightline.llm import pieces
from sightline.llm.common import vocabulary


def test_user_defined_pieces_are_refused(tmp_path):
    proto = pieces.model_pb2.ModelProto()
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.pieces[-1].type = pieces.model_pb2.ModelProto.SentencePiece.USER_DEFINED
    path = tmp_path / "user.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="user-defined"):
        pieces.PieceFst(str(path))
    pieces.PieceFst(vocabulary("piece_bpe_32k.model"))
