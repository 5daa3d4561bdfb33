"""Machines compiled from a SentencePiece model: a weighted transducer for ids and a counting transducer.

A normalised text falls into fragments that no piece crosses: blanks with the word after them, and line feeds. Both machines
read fragments. Whole batches of texts are cut at the bytes where fragments begin, and Arrow tells the fragments apart, so a machine reads each
distinct fragment of a slice once; what it finds is remembered, up to a bound.

``PieceFst`` is the composition of normaliser (dummy prefix, blanks to the piece's blank), pieces and byte fallback, taken lazily
with each input. Its arcs from a position are the pieces that start there. In a unigram model an arc weighs minus its
score. In a BPE model an arc weighs nothing if the piece can follow the one before it, that is if merging their joined text gives these two pieces again, and infinity
else; a sequence of pieces is the model's encoding exactly if all its neighbours are consistent in this way, and each place has one last piece. Either way
the ids are those on the path of least weight in the tropical semiring (min, +), found by relaxing the arcs in order of place: for all new fragments of a slice at once
in arrays, and for a long fragment alone.

``CountTransducer`` determinises the BPE machine. Its state is the longest end of the input that may still start a longer piece, with
the last piece and the relative token count before each place in it; a transition on a character carries the change of the
token count of what has been read. States and transitions are compiled as they are met. At a fragment's border it is in its start state again, so
a fragment maps the start state to itself with a number of tokens, these maps compose by addition, and a prefix sum over all fragments of a slice
composes them. A longer fragment is cut into chunks; a chunk's map holds the exit state and the tokens of each entry state that the text before it allows, and the maps
are composed pairwise.
"""

from __future__ import annotations

import codecs
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from sightline.llm.words import LONGEST_REMEMBERED, Memory, gathered, numbered, ragged, sums

BLANK = "▁"
#: Blanks with the word after them, a line feed, or the rest of a word after one. Line feeds are in no piece.
FRAGMENTS = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")
#: Consistent pairs and transitions that a worker remembers at once; past it they are compiled anew.
MEMORY = 800_000

#: Fragments that are relaxed at once.
AT_ONCE = 1 << 15

codecs.register_error("one-for-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def fragments(texts: pa.Array, dummy: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Fragments of all texts in a row, with blanks for the piece's blank: the number of each among the distinct ones, these, and how many each text has."""
    texts = pc.replace_substring(texts, BLANK, " ")
    if dummy:
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_buffer()
    data = np.frombuffer(whole, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), [], np.zeros(len(texts), np.int64)
    blank, feed = data == 32, data == 10
    starts = feed.copy()
    starts[1:] |= feed[:-1] | (blank[1:] & ~blank[:-1])
    starts[(ends - size)[size > 0]] = True
    at = np.flatnonzero(starts)
    offsets = np.append(at, len(data)).astype(np.int32)
    codes, distinct = numbered(pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), whole))
    return codes, distinct, np.searchsorted(at, ends) - np.searchsorted(at, ends - size)


class Table:
    """A hash table from integers of at least 0 to integers, in arrays, asked and filled in bulk."""

    def __init__(self, bits: int = 16):
        self.bits, self.held = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it has none."""
        out, open_, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._first(keys)
        while len(open_):
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (held >= 0)
            open_, at = open_[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that the table does not hold."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            some = self.keys >= 0
            keys, values = np.concatenate([self.keys[some], keys]), np.concatenate([self.values[some], values])
            self.__init__(max(self.bits + 1, (2 * len(keys)).bit_length()))
        self.held += len(keys)
        at = self._first(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.keys) - 1)


class PieceFst:
    """Encoder and decoder of one model file."""

    _open: dict[tuple, object] = {}

    def __init__(self, path: str):
        proto = model_pb2.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        kinds = model_pb2.ModelProto.SentencePiece
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only the identity normaliser is compiled")
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not compiled")
        self.bpe = proto.trainer_spec.model_type == model_pb2.TrainerSpec.BPE
        self.dummy = BLANK if proto.normalizer_spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        if any(re.search(f"[^{BLANK}]{BLANK}|\n", p) for p in self.ids):
            raise ValueError("a piece crosses the fragments")
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.outputs = [b""] * len(proto.pieces)
        for p, i in self.ids.items():
            self.outputs[i] = p.replace(BLANK, " ").encode()
        for b, i in self.bytes.items():
            self.outputs[i] = bytes([b])
        self.outputs[self.unknown] = " ⁇ ".encode()
        self.fallback_cost = max(-s for s in self.scores.values()) + 10
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.memory = Memory()
        self._compile_arcs()

    def _compile_arcs(self) -> None:
        """The pieces as a trie in arrays; node 0 stands for no piece's beginning. Pairs of pieces get their weights as they are met."""
        node = {"": 0} | {p: i + 1 for i, p in enumerate(sorted(self.prefixes))}
        self.piece_at = np.full(len(node), -1, np.int64)
        self.first = np.zeros(0x110000, np.int64)
        keys, children = [], []
        for p, i in node.items():
            self.piece_at[i] = self.ids.get(p, -1)
            if len(p) == 1:
                self.first[ord(p)] = i
            elif p:
                keys.append(node[p[:-1]] << 21 | ord(p[-1]))
                children.append(i)
        self.edges = Table()
        self.edges.put(np.array(keys, np.int64), np.array(children, np.int64))
        self.texts: list[str | None] = [None] * (len(self.outputs) + 1)  # of pieces; the last stands for no piece before
        self.weights = np.zeros(len(self.outputs))
        for p, i in self.ids.items():
            self.texts[i], self.weights[i] = p, -self.scores[p]
        self.known_pairs = Table()
        self.output_sizes = np.array(list(map(len, self.outputs)), np.int64)
        self.output_starts = np.cumsum(self.output_sizes) - self.output_sizes
        self.output_bytes = np.frombuffer(b"".join(self.outputs), np.uint8)

    @classmethod
    def at(cls, path: str):
        """One for each worker, class and file."""
        if (cls, path) not in cls._open:
            cls._open[cls, path] = cls(path)
        return cls._open[cls, path]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the adjacent pair of best score is joined, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def consistent(self, last: str | None, piece: str) -> bool:
        """Whether ``piece`` can follow ``last`` (None: nothing that merges with it)."""
        found = self.pairs.get((last, piece))
        if found is None:
            if len(self.pairs) >= 2 * MEMORY:
                self.pairs.clear()
            found = self._fits(last, piece)
            self.pairs[last, piece] = found
        return found

    def fallback(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "replace")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def _arcs(self, fragment: str, at: int) -> list[str | None]:
        """Pieces that start at a place, shortest first; None stands for byte fallback, taken where the character is no piece."""
        out: list[str | None] = [] if fragment[at] in self.ids else [None]
        end, n, prefixes, ids = at + 1, len(fragment), self.prefixes, self.ids
        while end <= n and (arc := fragment[at:end]) in prefixes:
            if arc in ids:
                out.append(arc)
            end += 1
        return out

    def path(self, fragment: str) -> list[int]:
        """Ids on the shortest path through one normalised fragment."""
        n, infinite = len(fragment), float("inf")
        cost = [0.0] + [infinite] * n
        back: list[tuple[int, str | None]] = [(0, None)] * (n + 1)
        for i in range(n):
            if cost[i] == infinite:
                continue
            for arc in self._arcs(fragment, i):
                j = i + len(arc or " ")
                if arc is None:
                    weight = cost[i] + self.fallback_cost
                elif self.bpe:
                    weight = cost[i] if self.consistent(back[i][1], arc) else infinite
                else:
                    weight = cost[i] - self.scores[arc]
                if weight < cost[j]:
                    cost[j], back[j] = weight, (i, arc)
        out, j = [], n
        while j:
            i, arc = back[j]
            out.append(self.fallback(fragment[i]) if arc is None else [self.ids[arc]])
            j = i
        return [x for ids in reversed(out) for x in ids]

    def _follows(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece can follow the one before it."""
        if self.known_pairs.held >= 4 * MEMORY:
            self.known_pairs = Table()
        keys = last * len(self.texts) + piece
        found = self.known_pairs.get(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            texts = self.texts
            fits = [self._fits(texts[k // len(texts)], texts[k % len(texts)]) for k in new.tolist()]
            self.known_pairs.put(new, np.array(fits, np.int64))
            found = self.known_pairs.get(keys)
        return found == 1

    def _fits(self, last: str | None, piece: str) -> bool:
        return self.merged(piece) == [piece] if last is None else self.merged(last + piece) == [last, piece]

    def paths(self, found: list[str]) -> list[bytes]:
        """Ids of short normalised fragments that have a character each: the relaxation of ``path`` at the same place of all of them at once."""
        size = np.array([len(f) for f in found], np.int64)
        points = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        of = np.repeat(np.arange(len(found)), size)
        ends, at = np.cumsum(size), np.arange(len(points))
        begins, end = (ends - size)[of], ends[of]
        places = at + of  # a fragment has one place more than characters
        nodes, arcs = self.first[points], []
        alone = self.piece_at[nodes] < 0
        arcs.append((places[alone], np.full(int(alone.sum()), -1), at[alone] - begins[alone] + 1, np.ones(int(alone.sum()), np.int64)))
        k = 1
        while len(at):
            piece = self.piece_at[nodes]
            some = piece >= 0
            arcs.append((places[some], piece[some], at[some] - begins[some] + k, np.full(int(some.sum()), k)))
            on = (nodes > 0) & (at + k < end)
            at, nodes, places, begins, end = at[on], nodes[on], places[on], begins[on], end[on]
            nodes = self.edges.get(nodes << 21 | points[at + k])
            on = nodes >= 0
            at, nodes, places, begins, end, k = at[on], nodes[on], places[on], begins[on], end[on], k + 1
        start, piece, place, length = (np.concatenate(x) for x in zip(*arcs))
        order = np.lexsort((length, place))  # of equal weights at a place the longest arc counts
        start, piece, place, length = start[order], piece[order], place[order], length[order]
        cuts = np.searchsorted(place, np.arange(1, place.max() + 2))
        n = len(points) + len(found)
        first = ends - size + np.arange(len(found))
        cost, back, last = np.full(n, np.inf), np.zeros(n, np.int64), np.full(n, -1)
        cost[first] = 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, p = start[a:b], piece[a:b]
            if self.bpe:
                weight = np.full(len(s), np.inf)
                weight[p < 0] = self.fallback_cost
                open_ = np.flatnonzero((p >= 0) & (cost[s] < np.inf))
                weight[open_[self._follows(last[s[open_]] % len(self.texts), p[open_])]] = 0
            else:
                weight = np.where(p < 0, self.fallback_cost, self.weights[p])
            weight = weight + cost[s]
            to = s + length[a:b]
            np.minimum.at(cost, to, weight)
            best = (weight == cost[to]) & (weight < np.inf)
            back[to[best]], last[to[best]] = s[best], p[best]
        now, of, taken = first + size, np.arange(len(found)), []
        while len(of):
            taken.append((of, last[now]))
            now = back[now]
            on = now > first[of]
            now, of = now[on], of[on]
        of, piece = (np.concatenate(x) for x in zip(*taken))
        step = np.repeat(np.arange(len(taken)), [len(x) for x, _ in taken])
        n = np.bincount(of, minlength=len(found))
        ends = np.cumsum(n)
        ids = np.empty(len(of), "<u4")
        ids[ends[of] - 1 - step] = piece
        raw, out = ids.tobytes(), []
        for a, z in zip((4 * (ends - n)).tolist(), (4 * ends).tolist()):
            out.append(raw[a:z])
        for i in np.unique(of[piece < 0]).tolist():  # bytes for characters without a piece
            out[i] = array("I", self.path(found[i])).tobytes()
        return out

    def normalised(self, text: str) -> str:
        return self.dummy + text.replace(" ", BLANK) if text else ""

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32."""
        return b"".join(self._remembered(FRAGMENTS.findall(self.normalised(text))))

    def _remembered(self, found: list[str]) -> list[bytes]:
        """Ids of normalised fragments, each of which has a character."""
        out = self.memory.get(found)
        new = [i for i, ids in enumerate(out) if ids is None]
        short = [i for i in new if len(found[i]) <= LONGEST_REMEMBERED]
        for k in range(0, len(short), AT_ONCE):
            some = short[k : k + AT_ONCE]
            for i, ids in zip(some, self.paths([found[i] for i in some])):
                out[i] = ids
                self.memory.put(found[i], ids)
        for i in new:
            if out[i] is None:
                out[i] = array("I", self.path(found[i])).tobytes()
        return out

    def _come_back(self, ids: np.ndarray, sizes: np.ndarray, found: list[str]) -> np.ndarray:
        """Whether the bytes that each fragment's ids stand for are the fragment's."""
        n = self.output_sizes[ids]
        got = self.output_bytes[ragged(self.output_starts[ids], n)]
        expected = np.frombuffer("".join(found).replace(BLANK, " ").encode(), np.uint8)
        lengths = np.array([len(f.encode()) - 2 * f.count(BLANK) for f in found], np.int64)
        fits = sums(n, sizes) == lengths
        return fits & (sums(got != expected, lengths) == 0) if fits.all() else np.array([b"".join(map(self.outputs.__getitem__, x)) == f.replace(BLANK, " ").encode() for f, x in zip(found, np.split(ids, np.cumsum(sizes)[:-1]))], bool)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, how many each has, and whether decoding them gives the text again.

        Decoding joins the pieces' bytes, so a text comes back if all its fragments do and it does not hold the piece's own blank.
        """
        codes, distinct, each = fragments(texts, bool(self.dummy))
        distinct = [f.replace(" ", BLANK) for f in distinct]
        ids = self._remembered(distinct)
        flat, n = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        same = self._come_back(flat, n, distinct)
        intact = (sums(~same[codes], each) == 0) & ~pc.match_substring(texts, BLANK).to_numpy(zero_copy_only=False)
        return *gathered(ids, codes, each), intact

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, without the dummy prefix; each invalid byte is one U+FFFD."""
        text = b"".join(map(self.outputs.__getitem__, ids)).decode("utf-8", "one-for-each-byte")
        first = next((i for i in ids if self.outputs[i]), self.unknown)
        return text[1:] if self.dummy and text.startswith(" ") and first != self.unknown else text


class CountTransducer(PieceFst):
    """Token counts of a BPE model by deterministic transitions."""

    START = ("", ((0, None, 0),))
    #: Characters of a fragment that are read in one go.
    CHUNK = 1 << 16

    def __init__(self, path: str):
        super().__init__(path)
        if not self.bpe:
            raise ValueError("the counting transducer is for BPE models")
        self.counts = Memory()
        self.longer = {p[:k] for p in self.ids for k in range(1, len(p))}  # what a longer piece begins with
        self.reach = max(map(len, self.longer), default=0)
        self._forget()

    def _forget(self) -> None:
        self.numbers = {self.START: 0}
        self.states = [self.START]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: dict[str, list[int]] = {"": [0]}
        self.compiled = 0

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition of a state on a character: (next state, change of the token count)."""
        end, places = self.states[state]
        emitted, piece, n = None, None, len(end)
        for k, last, before in places:  # a longer arc may hold a character that is no piece
            arc = end[n - k :] + char
            if arc in self.ids and self.consistent(last, arc):
                emitted, piece = before + 1, arc
                break
        if emitted is None:
            emitted = len(self.fallback(char))
        kept = tuple((k + 1, last, before - emitted) for k, last, before in places if end[n - k :] + char in self.longer)
        following = ((end + char)[n - kept[0][0] + 1 :] if kept else "", (*kept, (0, piece, 0)))
        number = self.numbers.setdefault(following, len(self.states))
        if number == len(self.states):
            self.states.append(following)
            self.moves.append({})
            self.ends.setdefault(following[0], []).append(number)
        self.compiled += 1
        move = self.moves[state][char] = number, emitted
        return move

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """(exit state, tokens) of part of a fragment."""
        total, moves = 0, self.moves
        for char in text:
            state, emitted = moves[state].get(char) or self._compile(state, char)
            total += emitted
        return state, total

    def chunk_map(self, before: str, chunk: str) -> tuple[str, dict[int, tuple[int, int]]]:
        """A chunk, and {entry state: (exit state, tokens)} over the compiled states that the text before it allows: their end is its longest end that may start a piece."""
        tail = before[-self.reach :] if self.reach else ""
        end = next((tail[k:] for k in range(len(tail)) if tail[k:] in self.longer), "")
        return chunk, {s: self.run(chunk, s) for s in tuple(self.ends.get(end, ()))}

    def composed(self, left: tuple, right: tuple) -> tuple[str, dict[int, tuple[int, int]]]:
        """The map of two neighbouring chunks; associative. An exit of the left that the right's map lacks is run."""
        (a, f), (b, g) = left, right
        out = {}
        for s, (middle, n) in f.items():
            if middle not in g:
                g[middle] = self.run(b, middle)
            out[s] = g[middle][0], n + g[middle][1]
        return a + b, out

    def fragment_count(self, fragment: str, chunk: int = CHUNK) -> int:
        """The tokens of one normalised fragment; of a long one by its chunks' maps, composed pairwise as in a prefix scan."""
        if self.compiled >= MEMORY:
            self._forget()
        if len(fragment) <= chunk:
            return self.run(fragment)[1]
        at = range(chunk, len(fragment), chunk)
        maps = [(fragment[:chunk], {0: self.run(fragment[:chunk])}), *(self.chunk_map(fragment[max(0, i - self.reach) : i], fragment[i : i + chunk]) for i in at)]
        while len(maps) > 1:
            maps = [self.composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][1][0][1]

    def _counted(self, found: list[str], chunk: int = CHUNK) -> list[int]:
        """Tokens of normalised fragments."""
        out = self.counts.get(found)
        for i, n in enumerate(out):
            if n is None:
                out[i] = self.fragment_count(found[i], chunk)
                self.counts.put(found[i], out[i])
        return out

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        return sum(self._counted(FRAGMENTS.findall(self.normalised(text)), chunk))

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        codes, distinct, each = fragments(texts, bool(self.dummy))
        return sums(np.array(self._counted([f.replace(" ", BLANK) for f in distinct]), np.int64)[codes], each)
