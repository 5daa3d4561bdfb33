"""Every registered query of the engine over the driver's tables, with its DuckDB equivalent.

The tables stand in for the dataflow's own: customer for people, orders for batches, lineitem for a batch's items, part for the registry,
events for frames and text blocks, embeddings for descriptors and small images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions import strings
from sightline.operators import boxes, frames, fuzzy, registry, text, vectors
from sightline.plans import recognition
from sightline.sources import sinks
from sightline.sources.tables import column_scan, table
from sightline.streaming import runs, states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- registry -----------------------------------------------------------------------------------------------------


@query("SELECT p_name FROM part WHERE p_name IS NOT NULL AND p_name <> ''")
def q01_name_scan(spark, d):
    return column_scan(table(spark, d, "part"), "p_name")


@query("SELECT c_name, min(c_custkey) AS c_custkey, count(*) AS n FROM customer WHERE c_name IS NOT NULL GROUP BY c_name")
def q02_point_lookup(spark, d):
    return registry.resolve_names(table(spark, d, "customer"), "c_name", "c_custkey")


@query("""
    WITH p AS (SELECT o_orderkey AS batch, o_custkey + o_orderkey % 2 AS person FROM orders)
    SELECT batch, person, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = batch AND o_custkey = person) AS found FROM p
""")
def q03_batch_exists(spark, d):
    orders = table(spark, d, "orders")
    pairs = orders.select(F.col("o_orderkey").alias("batch"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("person"))
    return registry.pair_exists(pairs, orders, {"batch": "o_orderkey", "person": "o_custkey"})


@query("SELECT l_orderkey, l_linenumber, p_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def q04_batch_items(spark, d):
    joined = registry.batch_items(table(spark, d, "lineitem"), table(spark, d, "part"), "l_partkey", "p_partkey")
    return joined.select("l_orderkey", "l_linenumber", "p_partkey", "p_name")


@query("""
    WITH s AS (SELECT l_returnflag, l_linestatus, (sum(l_quantity) + count(*)) / 1024 / 1024 AS size_mb FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, size_mb, CAST(row_number() OVER (ORDER BY size_mb DESC, l_returnflag, l_linestatus) AS INTEGER) AS place FROM s
""")
def q05_size_report(spark, d):
    from pyspark.sql import Window

    sizes = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(((F.sum("l_quantity") + F.count("*")) / 1024 / 1024).alias("size_mb"))
    w = Window.orderBy(F.desc("size_mb"), "l_returnflag", "l_linestatus")  # one row per flag and status
    return sizes.withColumn("place", F.row_number().over(w))


WANTED_BRANDS = ["Brand#1", "Brand#4", "Brand#17", "Brand#99"]


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#4', 'Brand#17', 'Brand#99')")
def q06_in_list(spark, d):
    return registry.in_list(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_brand", WANTED_BRANDS)


@query("SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') THEN 'kept' ELSE 'missing' END AS status FROM part")
def q06b_key_split(spark, d):
    cached = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return registry.key_split(table(spark, d, "part").select("p_partkey"), cached, "p_partkey", "l_partkey")


@query("""
    WITH s AS (SELECT l_orderkey, l_partkey, bool_or(l_returnflag <> 'R') AS seen FROM lineitem GROUP BY ALL),
    g AS (SELECT l_orderkey, list_sort(list(l_partkey) FILTER (NOT seen)) AS m FROM s GROUP BY l_orderkey)
    SELECT l_orderkey, coalesce(array_to_string(m, ','), '') AS only_registered, '' AS only_recognized, m IS NULL AS matched FROM g
""")
def q07_reconcile(spark, d):
    return registry.reconcile(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", F.col("l_returnflag") != "R")


@query("""
    WITH e AS (SELECT DISTINCT l_orderkey, l_partkey AS item FROM lineitem WHERE l_linestatus = 'F'),
    a AS (SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag = 'A' THEN l_partkey + 1000000 ELSE l_partkey END AS item FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F'),
    b AS (SELECT coalesce(e.l_orderkey, a.l_orderkey) AS l_orderkey, e.item AS ei, a.item AS ai FROM e FULL JOIN a ON e.l_orderkey = a.l_orderkey AND e.item = a.item)
    SELECT l_orderkey, coalesce(array_to_string(list_sort(list(ei) FILTER (ai IS NULL)), ','), '') AS only_registered,
           coalesce(array_to_string(list_sort(list(ai) FILTER (ei IS NULL)), ','), '') AS only_recognized, count(*) FILTER (ai IS NULL OR ei IS NULL) = 0 AS matched
    FROM b GROUP BY l_orderkey
""")
def q07b_reconcile_sets(spark, d):
    lines = table(spark, d, "lineitem").filter("l_linestatus = 'F'")
    expected = lines.select("l_orderkey", F.col("l_partkey").alias("item"))
    actual = lines.filter("l_returnflag <> 'R'").select("l_orderkey", F.expr("if(l_returnflag = 'A', l_partkey + 1000000, l_partkey)").alias("item"))
    return registry.reconcile_sets(actual, expected, "l_orderkey", "item")


@query("""
    WITH r AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN 'nobody' ELSE (SELECT c_name FROM customer WHERE c_custkey = o_custkey) END AS person,
                      CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS batch FROM orders),
    p AS (SELECT c_name, min(c_custkey) AS k FROM customer GROUP BY c_name),
    i AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS c FROM lineitem GROUP BY l_orderkey)
    SELECT request_id, CASE WHEN k IS NULL THEN 'no_person' WHEN o_orderkey IS NULL THEN 'no_batch' ELSE 'compared' END AS status,
           CASE WHEN k IS NOT NULL AND o_orderkey IS NOT NULL THEN coalesce(c, 0) ELSE 0 END AS n_items
    FROM r LEFT JOIN p ON person = c_name LEFT JOIN orders ON batch = o_orderkey AND k = o_custkey LEFT JOIN i ON o_orderkey = l_orderkey
""")
def q08_status_chain(spark, d):
    orders, people = table(spark, d, "orders"), table(spark, d, "customer")
    named = orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    requests = named.select(
        F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 3 == 0, "nobody").otherwise(F.col("c_name")).alias("person"),
        F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderkey") + 1000000000).otherwise(F.col("o_orderkey")).alias("batch"),
    )
    return registry.status_chain(
        requests, people.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("person_id")),
        orders.select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("person_id")),
        table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("item")),
    )


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def q09_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("""
    WITH u AS (SELECT p_partkey, upper(p_name) AS p_name, p_size + 1 AS p_size, 1 AS v FROM part WHERE p_size > 25
               UNION ALL SELECT p_partkey + 1000000, p_name, p_size, 2 FROM part WHERE p_size < 5
               UNION ALL SELECT p_partkey, p_name || '!', p_size, 3 FROM part WHERE p_size > 40),
    e AS (SELECT p_partkey, p_name, p_size, 0 AS v FROM part UNION ALL SELECT * FROM u)
    SELECT p_partkey, p_name, p_size FROM e QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY v DESC, p_name DESC) = 1
""")
def q10_upsert(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    one = part.filter("p_size > 25").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"), F.lit(1).alias("v"))
    two = part.filter("p_size < 5").select((F.col("p_partkey") + 1000000).alias("p_partkey"), "p_name", "p_size", F.lit(2).alias("v"))
    three = part.filter("p_size > 40").select("p_partkey", F.concat("p_name", F.lit("!")).alias("p_name"), "p_size", F.lit(3).alias("v"))
    return sinks.upsert(part, one.unionByName(two).unionByName(three), "p_partkey", "v")


@query("SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT p_partkey + 1000000, p_name || '*', NULL FROM part WHERE p_size < 5")
def q10b_insert(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return sinks.insert(part, part.filter("p_size < 5").select((F.col("p_partkey") + 1000000).alias("p_partkey"), F.concat("p_name", F.lit("*")).alias("p_name")))


# --- templates and vectors ----------------------------------------------------------------------------------------

TEMPLATES_SQL = "t AS (SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS template_no, embedding FROM embeddings QUALIFY template_no <= 6)"


def _templates(spark, d):
    return registry.first_templates(table(spark, d, "embeddings"), "label", "vec_id")


@query(f"WITH {TEMPLATES_SQL} SELECT label, template_no, vec_id FROM t")
def q11_templates(spark, d):
    return _templates(spark, d).select("label", "template_no", "vec_id")


@query(f"WITH {TEMPLATES_SQL} SELECT label, " + ", ".join(f"max(vec_id) FILTER (template_no = {i}) AS t{i}" for i in range(1, 7)) + " FROM t GROUP BY label")
def q11b_padded_templates(spark, d):
    return sinks.padded_templates(_templates(spark, d), "label", "template_no", "vec_id")


SHARE = 0.97
PAIRS_SQL = f"""{TEMPLATES_SQL},
    tv AS (SELECT vec_id, label AS item, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS tq FROM t),
    q AS (SELECT vec_id AS query, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS qq FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM tv)),
    d AS (SELECT query, item, CAST(list_sum(list_transform(list_zip(qq, tq), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM q, tv),
    p AS (SELECT query, item, min(d) AS d1, max(d) FILTER (rn = 2) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY query, item ORDER BY d) AS rn FROM d) WHERE rn <= 2 GROUP BY query, item)"""


def _pairs(spark, d):
    """The two nearest templates of every item for each vector that is not a template."""
    chosen = _templates(spark, d).select(F.col("vec_id").alias("template"), F.col("label").alias("item"), vectors.quantised(F.col("embedding")).alias("tq"))
    images = table(spark, d, "embeddings").join(chosen.select(F.col("template").alias("vec_id")), "vec_id", "left_anti")
    queries = images.select(F.col("vec_id").alias("query"), vectors.quantised(F.col("embedding")).alias("qq"))
    return vectors.nearest_two(queries, chosen, "query", "qq", "item", "tq")


@query(f"WITH {PAIRS_SQL} SELECT query, item, d1, d2, coalesce(d1 < {SHARE * SHARE} * d2, false) AS good FROM p")
def q20_ratio_test(spark, d):
    pairs = _pairs(spark, d)
    return pairs.select("query", "item", "d1", "d2", vectors.ratio_passes(pairs, F.lit(SHARE * SHARE)).alias("good"))


@query(f"WITH {PAIRS_SQL} SELECT item, count(*) AS n_queries, count(*) FILTER (d1 < {SHARE * SHARE} * d2) AS good FROM p GROUP BY item")
def q20b_good_matches(spark, d):
    return vectors.good_matches(_pairs(spark, d), "item", SHARE)


@query(f"""
    WITH {PAIRS_SQL}, s AS (SELECT query, item, 20 * CAST(d1 < d2 AS INTEGER) + (d2 - d1) % 17 AS score FROM p),
    b AS (SELECT query, item, score AS best, least(1.0, score / 15.0) * 0.6 AS confidence FROM s)
    SELECT query, item, best, confidence, CAST(row_number() OVER (PARTITION BY query ORDER BY confidence DESC, item) AS INTEGER) AS rank FROM b QUALIFY rank <= 3
""")
def q21_best_items(spark, d):
    scores = _pairs(spark, d).select("query", "item", F.expr("20 * int(d1 < d2) + (d2 - d1) % 17").alias("score"))
    return vectors.best_items(scores, "query", "item", "score", "item")


@query(f"""
    WITH {TEMPLATES_SQL}, v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings),
    c AS (SELECT vec_id AS query, v, k AS position, CAST((label + 3 * k) % 10 AS INTEGER) AS item FROM v, unnest([0, 1, 2]) AS u(k) WHERE vec_id % 20 = 0),
    s AS (SELECT query, item, position, list_inner_product(c.v, v.v) / 200 AS score FROM c JOIN t ON item = t.label JOIN v ON t.vec_id = v.vec_id),
    b AS (SELECT query, item, min(position) AS position, max(score) AS best FROM s GROUP BY query, item), f AS (SELECT *, least(1.0, best / 15.0) * 0.6 AS confidence FROM b)
    SELECT query, item, round(best, 9) AS best, round(confidence, 9) AS confidence, CAST(row_number() OVER (PARTITION BY query ORDER BY confidence DESC, position) AS INTEGER) AS rank FROM f
""")
def q21c_candidate_templates(spark, d):
    """Three candidate items of each queried vector, scored on up to six templates each."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))
    templates = _templates(spark, d).select(F.col("label").alias("item"), whole.alias("template"))
    asked = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label", whole.alias("v"), F.explode(F.array(*map(F.lit, range(3)))).alias("position"))
    candidates = asked.select("query", "v", "position", ((F.col("label") + 3 * F.col("position")) % 10).cast("int").alias("item"))
    scores = vectors.template_scores(candidates, templates, "item", "v", "template").withColumn("score", F.col("score") / 200)
    best = vectors.best_items(scores, "query", "item", "score", "position")
    return best.select("query", "item", F.round("best", 9).alias("best"), F.round("confidence", 9).alias("confidence"), "rank")


@query(f"WITH {PAIRS_SQL} SELECT item, count(*) AS votes, round(count(*) + 0.1 * sum(1 / (d1 + 1e-6)), 6) AS weighted, round(0.7 * (count(*) / 1000.0) + 0.3 * least(1.0, count(*) / 15.0), 6) AS confidence FROM p WHERE d1 < d2 GROUP BY item")
def q21b_weighted_votes(spark, d):
    votes = vectors.weighted_votes(_pairs(spark, d).filter("d1 < d2"), ["item"], "d1")
    conf = vectors.vote_confidence(F.col("votes") / 1000.0, F.col("votes"))
    return votes.select("item", "votes", F.round("weighted", 6).alias("weighted"), F.round(conf, 6).alias("confidence"))


@query("""
    WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT label, p, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL)
    SELECT label, CAST(p - 1 AS INTEGER) AS p, round(x, 9) AS x FROM m
""")
def q43_mean_vector(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return vectors.mean_vector(rows, "label", "v").select("label", F.posexplode("mean").alias("p", "x")).withColumn("x", F.round("x", 9))


# --- text -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(c) AS clean_md5, length(c) AS n FROM (SELECT doc_id, regexp_replace(text, '[^a-z]', '', 'g') AS c FROM documents) WHERE c <> ''")
def q12_keep_class(spark, d):
    return text.cleaned(table(spark, d, "documents"), "text", "[^a-z]").select("doc_id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("n"))


@query("""
    WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: replace(x, ' ', '')) AS ls FROM documents),
    f AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: regexp_extract(x, '([A-Z][a-z]+)', 1)), lambda x: x <> '')[-1] AS name,
                 list_filter(list_transform(ls, lambda x: regexp_extract(x, '([0-9]+)', 1)), lambda x: x <> '')[-1] AS number,
                 list_filter(list_transform(ls, lambda x: regexp_extract(x, '([a-z]{3}[.])', 1)), lambda x: x <> '')[-1] AS ending FROM l)
    SELECT doc_id, name, number, ending, CASE WHEN name IS NULL OR number IS NULL OR ending IS NULL THEN 'missing' ELSE 'ok' END AS status FROM f
""")
def q13_fields(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return text.extract_fields(lines, "lines", {"name": "[A-Z][a-z]+", "number": "[0-9]+", "ending": "[a-z]{3}[.]"}).drop("lines")


@query("SELECT p_partkey, CASE WHEN length(trim(p_name)) < 9 THEN 'empty' ELSE 'ok' END AS bottle, CASE WHEN length(trim(p_name)) < 8 THEN 'empty' ELSE 'ok' END AS bag FROM part")
def q14_length_guard(spark, d):
    return table(spark, d, "part").select("p_partkey", text.length_guard(F.col("p_name"), 9).alias("bottle"), text.length_guard(F.col("p_name"), 8).alias("bag"))


GAP = 6 * 3600
LINES_SQL = f"""s AS (SELECT user_id, event_id, event_type, value, epoch(ts) AS y FROM events),
    n AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY user_id ORDER BY y, event_id)) > {GAP} THEN 1 ELSE 0 END AS b FROM s),
    m AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY y, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line FROM n)"""


def _numbered(spark, d):
    rows = table(spark, d, "events").withColumn("y", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return text.line_numbers(rows, "user_id", F.col("y"), ["event_id"], GAP)


@query(f"WITH {LINES_SQL}, l AS (SELECT user_id, line, string_agg(event_type, '' ORDER BY y, event_id) AS t FROM m GROUP BY user_id, line) SELECT user_id, count(*) AS n_lines, string_agg(t, '' ORDER BY line) AS text FROM l GROUP BY user_id")
def q15_line_merge(spark, d):
    return text.joined_lines(text.merged_lines(_numbered(spark, d), "user_id", "event_type", ["y", "event_id"]), "user_id")


@query(f"WITH {LINES_SQL} SELECT user_id, line, string_agg(event_type, '' ORDER BY value, event_id) AS text FROM m GROUP BY user_id, line")
def q15b_line_merge_by_x(spark, d):
    return text.merged_lines(_numbered(spark, d), "user_id", "event_type", ["value", "event_id"])


@query(f"WITH {LINES_SQL} SELECT user_id, string_agg(event_type, '' ORDER BY y, event_id) AS text FROM m WHERE line = 0 GROUP BY user_id")
def q16_first_line(spark, d):
    return text.merged_lines(_numbered(spark, d).filter("line = 0"), "user_id", "event_type", ["y", "event_id"]).select("user_id", "text")


@query("""
    WITH s AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda c: ascii(c) % 5) AS a FROM part),
    k AS (SELECT p_partkey, list_filter(range(1, len(a) + 1), lambda i: a[i] <> 0 AND (i = 1 OR a[i] <> a[i - 1])) AS i, a FROM s)
    SELECT p_partkey, array_to_string(list_transform(i, lambda j: a[j]), '') AS decoded, CAST(len(i) AS INTEGER) AS n FROM k
""")
def q17_collapse(spark, d):
    steps = F.transform(F.split("p_name", ""), lambda c: F.ascii(c) % 5)
    rows = table(spark, d, "part").select("p_partkey", text.collapse(steps).alias("a"))
    return rows.select("p_partkey", F.array_join(F.col("a").cast("array<string>"), "").alias("decoded"), F.size("a").alias("n"))


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), x AS (SELECT vec_id, v, list_max(v) AS m, list_min(v) AS lo FROM e),
    z AS (SELECT vec_id, CASE WHEN m > 1 OR lo < 0 THEN list_transform(v, lambda y: exp(y - m)) END AS ex, v FROM x)
    SELECT vec_id, round(coalesce(ex[1] / (ex[1] + ex[2] + ex[3] + ex[4]), v[1]), 9) AS p1, round(coalesce(ex[4] / (ex[1] + ex[2] + ex[3] + ex[4]), v[4]), 9) AS p4 FROM z
""")
def q17b_softmax(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("v"))
    p = text.softmax(F.col("v"))
    return rows.select("vec_id", F.round(p[0], 9).alias("p1"), F.round(p[3], 9).alias("p4"))


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), i AS (SELECT vec_id, v, unnest(range(8)) AS i FROM e),
    s AS (SELECT vec_id, i, list_max(v) > 1 OR list_min(v) < 0 AS outside, v[8 * i + 1:8 * i + 8] AS r FROM i), m AS (SELECT *, list_max(r) AS m FROM s),
    b AS (SELECT vec_id, i, list_position(r, m) - 1 AS c, CASE WHEN outside THEN 1 / list_sum(list_transform(r, lambda y: exp(y - m))) ELSE m END AS p FROM m),
    k AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY vec_id ORDER BY i) <> c, true) AND c <> 0 AS kept FROM b)
    SELECT vec_id, coalesce(string_agg(substr('abcdefg', CAST(c AS INTEGER), 1), '' ORDER BY i) FILTER (kept), '') AS text, round(coalesce(avg(p) FILTER (kept), 0), 9) AS confidence FROM k GROUP BY vec_id
""")
def q17c_ctc_decode(spark, d):
    """A vector read as eight steps of eight scores."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, F.lit(8)), lambda x: x.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", scores.alias("scores"))
    found = text.ctc_decode(rows, "scores", F.array(*[F.lit(c) for c in ("", *"abcdefg")]))
    return found.select("vec_id", "text", F.round("confidence", 9).alias("confidence"))


# --- fuzzy matching ---------------------------------------------------------------------------------------------------

NOISY_SQL = """CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 1, CAST(p_partkey % length(p_name) AS INTEGER)) || 'x' || substr(p_name, CAST(p_partkey % length(p_name) AS INTEGER) + 2)
    WHEN 1 THEN substr(p_name, 1, CAST(p_partkey % length(p_name) AS INTEGER)) || substr(p_name, CAST(p_partkey % length(p_name) AS INTEGER) + 2)
    WHEN 2 THEN substr(p_name, 1, CAST(p_partkey % length(p_name) AS INTEGER) + 1) || substr(p_name, CAST(p_partkey % length(p_name) AS INTEGER) + 1) ELSE p_name END"""
SCORED_SQL = f"""q AS (SELECT DISTINCT {NOISY_SQL} AS text FROM part), r AS (SELECT DISTINCT p_name AS name FROM part),
    w AS (SELECT text, name, CASE WHEN length(text) <= length(name) THEN text ELSE name END AS s, CASE WHEN length(text) <= length(name) THEN name ELSE text END AS l FROM q, r),
    c AS (SELECT text, name, CAST(list_max(list_transform(range(1, length(l) - length(s) + 2), lambda i: round(100.0 * (1 - levenshtein(substr(l, CAST(i AS INTEGER), CAST(length(s) AS INTEGER)), s) / length(s))))) AS INTEGER) AS score FROM w),
    k AS (SELECT text, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, name) AS INTEGER) AS rank, name, score FROM c WHERE score >= 50 QUALIFY rank <= 10)"""


def _noisy(spark, d):
    return table(spark, d, "part").select(recognition.noisy(F.col("p_name"), F.col("p_partkey")).alias("text"))


@query(f"WITH {SCORED_SQL} SELECT * FROM k")
def q18_fuzzy_top_k(spark, d):
    return fuzzy.top_k(_noisy(spark, d), table(spark, d, "part"), "text", "p_name")


@query("""
    WITH r AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name ELSE '0' || p_brand END AS text FROM part),
    m AS (SELECT text, name FROM q JOIN r ON text = name)
    SELECT text, name, false AS fallback FROM m UNION ALL SELECT text, name, true FROM q, r WHERE text NOT IN (SELECT text FROM m)
""")
def q19_all_names(spark, d):
    part = table(spark, d, "part")
    texts = part.select(F.expr("if(p_size % 2 = 0, p_name, concat('0', p_brand))").alias("text"))
    exact = texts.distinct().join(part.select(F.col("p_name").alias("name")).distinct(), F.col("text") == F.col("name"))
    return fuzzy.or_all(texts, exact, part, "text", "p_name")


@query()
def q18b_indel_top_k(spark, d):
    """The insert/delete scorer; DuckDB has no equal of it, tests hold it against values by hand."""
    return fuzzy.top_k(_noisy(spark, d), table(spark, d, "part"), "text", "p_name", k=3, scorer=fuzzy.indel_score)


# --- boxes ------------------------------------------------------------------------------------------------------------


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
    SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS cls, list_max(v) AS conf FROM e WHERE list_max(v) >= 0.1
""")
def q22_best_class(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v"))
    return boxes.best_class(rows, F.col("v"), 0.1).drop("v")


FRAMES_SQL = "f AS (SELECT s_suppkey AS frame, 700 + CAST(s_suppkey % 11 AS INTEGER) * 190 AS w, 500 + CAST(s_suppkey % 7 AS INTEGER) * 230 AS h FROM supplier)"


def _frames(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame"), (700 + F.col("s_suppkey").cast("int") % 11 * 190).alias("w"), (500 + F.col("s_suppkey").cast("int") % 7 * 230).alias("h"))


@query(f"""WITH {FRAMES_SQL}, x AS (SELECT *, unnest(range(0, w, 512)) AS x1 FROM f), y AS (SELECT *, unnest(range(0, h, 512)) AS y1 FROM x)
    SELECT frame, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(least(x1 + 640, w) AS INTEGER) AS x2, CAST(least(y1 + 640, h) AS INTEGER) AS y2 FROM y""")
def q23_tile_grid(spark, d):
    return _frames(spark, d).select("frame", F.explode(g.tile_grid(F.col("w"), F.col("h"), 640, 128)).alias("t")).select("frame", "t.*")


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT *, CASE WHEN w > 1024 THEN greatest(1, ceil((w - 128) / 896.0)) ELSE 1 END AS nx, CASE WHEN h > 1024 THEN greatest(1, ceil((h - 128) / 896.0)) ELSE 1 END AS ny FROM f),
    x AS (SELECT *, unnest(range(0, CAST(nx AS BIGINT))) AS i FROM c), y AS (SELECT *, unnest(range(0, CAST(ny AS BIGINT))) AS j FROM x),
    p AS (SELECT frame, w, h, CASE WHEN w > 1024 THEN least(i * 896, w - 1024) ELSE 0 END AS x1, CASE WHEN h > 1024 THEN least(j * 896, h - 1024) ELSE 0 END AS y1 FROM y)
    SELECT frame, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(least(x1 + 1024, w) AS INTEGER) AS x2, CAST(least(y1 + 1024, h) AS INTEGER) AS y2 FROM p""")
def q23b_shifted_tile_grid(spark, d):
    return _frames(spark, d).select("frame", F.explode(g.shifted_tile_grid(F.col("w"), F.col("h"), 1024, 128)).alias("t")).select("frame", "t.*")


RAW_SQL = """r AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_partkey % 700 AS DOUBLE) AS cx, CAST(l_orderkey % 690 AS DOUBLE) AS cy, l_quantity AS w, CAST(l_linenumber * 7 AS DOUBLE) AS h FROM lineitem)"""


def _raw(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 700).cast("double").alias("cx"), (F.col("l_orderkey") % 690).cast("double").alias("cy"),
        F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 7).cast("double").alias("h"),
    )


@query(f"""WITH {RAW_SQL}, b AS (SELECT l_orderkey, l_linenumber, least(cx - w / 2, 640) + l_suppkey % 3 * 512 AS x1, least(cy - h / 2, 640) + l_suppkey % 2 * 512 AS y1,
    least(cx + w / 2, 640) + l_suppkey % 3 * 512 AS x2, least(cy + h / 2, 640) + l_suppkey % 2 * 512 AS y2 FROM r)
    SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(trunc(x1), 1600)) AS INTEGER) AS x1, CAST(greatest(0, least(trunc(y1), 1100)) AS INTEGER) AS y1,
           CAST(greatest(0, least(trunc(x2), 1600)) AS INTEGER) AS x2, CAST(greatest(0, least(trunc(y2), 1100)) AS INTEGER) AS y2 FROM b WHERE x2 > x1 AND y2 > y1""")
def q24_map_boxes(spark, d):
    raw = _raw(spark, d)
    c = g.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    moved = g.in_tile(c, F.lit(640), F.lit(640), F.col("l_suppkey") % 3 * 512, F.col("l_suppkey") % 2 * 512)
    rows = raw.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in moved.items()])
    rows = rows.filter(g.proper({k: F.col(k) for k in moved}))
    return rows.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in g.clipped({k: F.col(k) for k in moved}, 1600, 1100).items()])


@query(f"""WITH {RAW_SQL}, s AS (SELECT l_orderkey, l_linenumber, cx * (3300 / 640.0) + 100 AS cx, cy * (2060 / 640.0) + 100 AS cy, w * (3300 / 640.0) AS w, h * (2060 / 640.0) AS h FROM r)
    SELECT l_orderkey, l_linenumber, round(cx - w / 2, 6) AS x1, round(cy - h / 2, 6) AS y1, round(cx + w / 2, 6) AS x2, round(cy + h / 2, 6) AS y2 FROM s""")
def q24b_roi_boxes(spark, d):
    box = g.from_roi({k: F.col(k) for k in ("cx", "cy", "w", "h")}, (100, 100, 3400, 2160))
    return _raw(spark, d).select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(k) for k, v in box.items()])


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 900 AS INTEGER) - 50 AS a, CAST(l_orderkey % 500 AS INTEGER) - 20 AS b, CAST(l_suppkey % 1000 AS INTEGER) * 9 AS c, CAST(l_quantity AS INTEGER) * 20 AS e FROM lineitem),
    k AS (SELECT *, greatest(0, least(a, 639)) AS a1, greatest(0, least(b, 359)) AS b1, greatest(0, least(c, 639)) AS c1, greatest(0, least(e, 359)) AS e1 FROM r),
    v AS (SELECT *, a < c AND b < e AND a1 < c1 AND b1 < e1 AS cropped FROM k)
    SELECT l_orderkey, l_linenumber, if(cropped, a1, 0) AS x1, if(cropped, b1, 0) AS y1, if(cropped, c1, 640) AS x2, if(cropped, e1, 360) AS y2, cropped FROM v""")
def q24c_crop_region(spark, d):
    i = lambda c: F.col(c).cast("int")
    region = g.crop_region(i("l_partkey") % 900 - 50, i("l_orderkey") % 500 - 20, i("l_suppkey") % 1000 * 9, i("l_quantity") * 20, F.lit(640), F.lit(360))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", region.alias("r")).select("l_orderkey", "l_linenumber", "r.*")


NMS_THRESHOLD = 0.3
BOXES_SQL = "b AS (SELECT l_suppkey AS frame, CAST(l_linenumber % 3 AS INTEGER) AS cls, l_orderkey * 10 + l_linenumber AS id, max(l_extendedprice) AS score, max(l_partkey % 97) AS x1, max(l_orderkey % 89) AS y1 FROM lineitem GROUP BY ALL)"


def _nms_sql(group: str) -> str:
    """Greedy suppression by recursion over the rank in the group, carrying the kept boxes."""
    on = " AND ".join(f"k.{c} = n.{c}" for c in group.split(", "))
    over = "greatest(least(z.x1, n.x1) + 20 - greatest(z.x1, n.x1), 0) * greatest(least(z.y1, n.y1) + 20 - greatest(z.y1, n.y1), 0)"
    return f"""WITH RECURSIVE {BOXES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY {group}) AS total FROM b),
    k AS (SELECT {group}, rn, total, [{{'id': id, 'x1': x1, 'y1': y1}}] AS kept FROM n WHERE rn = 1
          UNION ALL SELECT {", ".join("n." + c for c in group.split(", "))}, n.rn, n.total,
            CASE WHEN len(list_filter(k.kept, lambda z: {over} > {NMS_THRESHOLD} * (800 - {over}))) > 0 THEN k.kept ELSE list_append(k.kept, {{'id': n.id, 'x1': n.x1, 'y1': n.y1}}) END
          FROM k JOIN n ON {on} AND n.rn = k.rn + 1)
    SELECT {group}, unnest(list_transform(kept, lambda z: z.id)) AS id FROM k WHERE rn = total"""


def _boxes(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("frame"), (F.col("l_linenumber") % 3).alias("cls"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    b = rows.agg(F.max("l_extendedprice").alias("score"), F.max(F.col("l_partkey") % 97).alias("x1"), F.max(F.col("l_orderkey") % 89).alias("y1"))
    return b.withColumn("x2", F.col("x1") + 20).withColumn("y2", F.col("y1") + 20)


@query(_nms_sql("frame, cls"))
def q25_suppress_per_class(spark, d):
    return boxes.suppressed(_boxes(spark, d), ["frame", "cls"], NMS_THRESHOLD).select("frame", "cls", "id")


@query(_nms_sql("frame"))
def q26_suppress(spark, d):
    return boxes.suppressed(_boxes(spark, d), ["frame"], NMS_THRESHOLD).select("frame", "id")


@query("SELECT l_suppkey AS frame, count(*) FILTER (l_linenumber % 4 = 0) AS bottles, count(*) FILTER (l_linenumber % 4 = 1) AS bags, count(*) FILTER (l_linenumber % 4 = 2) AS infusions, count(*) FILTER (l_linenumber % 4 = 3) AS others FROM lineitem GROUP BY l_suppkey")
def q27_routing(spark, d):
    rows = table(spark, d, "lineitem").withColumn("kind", boxes.kind(F.col("l_linenumber") % 4))
    count = lambda c: F.count_if(c)
    return rows.groupBy(F.col("l_suppkey").alias("frame")).agg(
        count(F.col("kind") == "bottle").alias("bottles"), count(F.col("kind") == "bag").alias("bags"), count(F.col("kind") == "infusion").alias("infusions"), count(F.col("kind").isNull()).alias("others"))


@query("""WITH p AS (SELECT s_suppkey AS frame, unnest(range(0, 4)) AS tile FROM supplier), q AS (SELECT frame, tile % 2 * 6 AS tx, tile // 2 * 6 AS ty, unnest(range(0, 81)) AS k FROM p),
    r AS (SELECT frame, tx + k % 9 AS x, ty + k // 9 AS y, (frame + tx * 5 + ty * 3 + k // 7) % 3 AS cls, exp(-((-1 + 2 * (k % 9) / 8.0) ** 2 + (-1 + 2 * (k // 9) / 8.0) ** 2) / 0.5) AS w FROM q),
    s AS (SELECT frame, x, y, cls, round(sum(w), 9) AS w FROM r GROUP BY ALL)
    SELECT frame, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, cls FROM s QUALIFY row_number() OVER (PARTITION BY frame, x, y ORDER BY w DESC, cls) = 1""")
def q35_tile_votes(spark, d):
    tiles = table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("t"))
    rows = tiles.select("frame", (F.col("t") % 2 * 6).alias("tx"), (F.floor(F.col("t") / 2) * 6).cast("int").alias("ty"), F.explode(F.sequence(F.lit(0), F.lit(80))).alias("k"))
    rows = rows.select("frame", "tx", "ty", F.floor(F.col("k") / 9).cast("int").alias("i"), (F.col("k") % 9).alias("j"), ((F.col("frame") + F.col("tx") * 5 + F.col("ty") * 3 + F.floor(F.col("k") / 7)) % 3).alias("cls"))
    return boxes.tile_votes(rows, 9)


def _mask(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 60).cast("int").alias("x"), (F.col("l_orderkey") % 40).cast("int").alias("y"), "l_quantity")
    return rows


PIXELS_SQL = "SELECT DISTINCT l_suppkey AS frame, CAST(l_partkey % 60 AS INTEGER) AS x, CAST(l_orderkey % 40 AS INTEGER) AS y FROM lineitem WHERE "
REGIONS_SQL = """e AS (SELECT a.frame, a.x AS ax, a.y AS ay, b.x, b.y FROM p a JOIN p b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
    r AS (SELECT frame, x AS ax, y AS ay, x, y FROM p UNION SELECT r.frame, r.ax, r.ay, e.x, e.y FROM r JOIN e ON r.frame = e.frame AND r.x = e.ax AND r.y = e.ay),
    o AS (SELECT frame, ax AS x, ay AS y, min(y * 1000 + x) AS root FROM r GROUP BY ALL),
    g AS (SELECT frame, root, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM o GROUP BY frame, root),
    n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY root) - 1 AS region FROM g)"""


@query(f"WITH RECURSIVE p AS ({PIXELS_SQL} l_quantity > 30), {REGIONS_SQL} SELECT frame, CAST(region AS INTEGER) AS region, CAST(area AS INTEGER) AS area, x, y, w, h FROM n WHERE area >= 3")
def q36_components(spark, d):
    """8-connected regions; tests hold them against a flood fill as well."""
    return boxes.components(_mask(spark, d).filter("l_quantity > 30"), "frame", 3)


@query(f"""WITH RECURSIVE p AS ({PIXELS_SQL} CAST(trunc(l_quantity * 3) AS INTEGER) BETWEEN 90 AND 145), {REGIONS_SQL}
    SELECT frame, CAST(area AS INTEGER) AS area, greatest(x - 10, 0) AS x1, greatest(y - 10, 0) AS y1, least(x + w + 10, 60) AS x2, least(y + h + 10, 40) AS y2
    FROM n QUALIFY row_number() OVER (PARTITION BY frame ORDER BY area DESC, region) = 1""")
def q40_largest_region(spark, d):
    """Colour range, then the largest region of each frame, padded."""
    pixels = _mask(spark, d).select("frame", "x", "y", (F.col("l_quantity") * 3).cast("int").alias("h"), F.lit(100).alias("s"), F.lit(200).alias("v"))
    return boxes.largest_region(boxes.components(boxes.colour_mask(pixels), "frame"), "frame", 60, 40, 10)


@query("SELECT l_orderkey, l_linenumber, l_quantity * 40 AS area, l_quantity AS w, l_linenumber * 5 AS h FROM lineitem WHERE l_quantity * 40 >= 500 AND l_quantity / (l_linenumber * 5) > 1.2 AND l_quantity / (l_linenumber * 5) < 6")
def q39_contour_gate(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return boxes.contour_gate(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (q * 40).alias("area"), q.alias("w"), (n * 5).alias("h")))


@query("""WITH c AS (SELECT l_suppkey AS image, l_orderkey AS contour, CAST(max(l_linenumber) AS INTEGER) AS n_points, max(l_quantity) / 4 AS side, max(l_discount) * 10 AS score FROM lineitem GROUP BY ALL),
    f AS (SELECT *, side * 1.45 AS grown_side FROM c QUALIFY row_number() OVER (PARTITION BY image ORDER BY contour) <= 50)
    SELECT image, contour, n_points, side, score FROM f WHERE n_points >= 4 AND side >= 3 AND score >= 0.5 AND grown_side >= 5""".replace("1.45", "CAST(1.45 AS DOUBLE)"))
def q39b_text_box_gate(spark, d):
    """Text-box candidates; the limit of candidates an image is the feature."""
    found = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("image"), F.col("l_orderkey").alias("contour")).agg(
        F.max("l_linenumber").alias("n_points"), (F.max("l_quantity") / 4).alias("side"), (F.max("l_discount") * 10).alias("score"))
    return boxes.text_box_gate(found.withColumn("grown_side", F.col("side") * 1.45), limit=50).drop("grown_side")


@query("""WITH b AS (SELECT l_suppkey AS image, l_partkey % 60 AS x, l_orderkey % 40 AS y, l_discount AS p, l_suppkey % 10 AS k FROM lineitem)
    SELECT image, 1 AS box, round(avg(p), 9) AS mean FROM b
    WHERE 35 * (y - 5) - (8 + k - 5) * (x - 5) >= 0 AND 5 * (y - 8 - k) - (22 - k) * (x - 40) >= 0 AND -42 * (y - 30) - (28 - 30) * (x - 45) >= 0 AND 2 * (y - 28) - (5 - 28) * (x - 3) >= 0
    GROUP BY image""")
def q35b_region_mean(spark, d):
    """The mean of the pixels inside a quadrilateral that leans by the image's number."""
    pixels = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 60).alias("x"), (F.col("l_orderkey") % 40).alias("y"), F.col("l_discount").alias("p"))
    point = lambda x, y: F.struct(F.lit(x).cast("long").alias("x"), y.cast("long").alias("y"))
    points = F.array(point(5, F.lit(5)), point(40, 8 + F.col("image") % 10), point(45, F.lit(30)), point(3, F.lit(28)))
    found = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image")).select("image", F.lit(1).alias("box"), points.alias("points"))
    return boxes.region_mean(pixels, found).select("image", "box", F.round("mean", 9).alias("mean"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS ax, l_suppkey % 40 AS ay, 50 + l_orderkey % 60 AS bx, l_partkey % 30 AS ay2, 50 + l_suppkey % 70 AS cx, 40 + l_orderkey % 90 AS cy, l_partkey % 40 AS dx, 40 + l_suppkey % 50 AS dy FROM lineitem),
    s AS (SELECT l_orderkey, l_linenumber, CAST(trunc(greatest(sqrt((ax - bx) * (ax - bx) + (ay - ay2) * (ay - ay2)), sqrt((dx - cx) * (dx - cx) + (dy - cy) * (dy - cy)))) AS INTEGER) AS w,
                 CAST(trunc(greatest(sqrt((ax - dx) * (ax - dx) + (ay - dy) * (ay - dy)), sqrt((bx - cx) * (bx - cx) + (ay2 - cy) * (ay2 - cy)))) AS INTEGER) AS h FROM c)
    SELECT *, h >= w * 1.5 AS turned FROM s""")
def q44b_crop_size(spark, d):
    """Size of a perspective crop from its corners: top left, top right, bottom right, bottom left."""
    o, k, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    size = g.crop_size(corner(k % 50, s % 40), corner(50 + o % 60, k % 30), corner(50 + s % 70, 40 + o % 90), corner(k % 40, 40 + s % 50))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", size.alias("c")).select("l_orderkey", "l_linenumber", "c.*")


FIT = "q AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 1700 AS INTEGER) AS x, CAST(l_orderkey % 900 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) * 9 AS w, l_linenumber * 61 AS h FROM lineitem)"


@query(f"""WITH {FIT}, a AS (SELECT *, CASE WHEN w / h >= 0.8 THEN CAST(w AS DOUBLE) ELSE h * 0.8 END AS nw, CASE WHEN w / h >= 0.8 THEN w / 0.8 ELSE CAST(h AS DOUBLE) END AS nh FROM q),
    s AS (SELECT *, least(1920 / nw, 1080 / nh, 1.0) AS k FROM a), t AS (SELECT *, CAST(trunc(nw * k) AS INTEGER) AS fw, CAST(trunc(nh * k) AS INTEGER) AS fh FROM s)
    SELECT l_orderkey, l_linenumber, greatest(0, least(CAST(trunc(x + w / 2.0 - fw / 2.0) AS INTEGER), 1920 - fw)) AS x, greatest(0, least(CAST(trunc(y + h / 2.0 - fh / 2.0) AS INTEGER), 1080 - fh)) AS y, fw AS w, fh AS h FROM t""".replace("w / h >= 0.8", "CAST(w AS DOUBLE) / h >= CAST(0.8 AS DOUBLE)").replace("h * 0.8", "h * CAST(0.8 AS DOUBLE)").replace("w / 0.8", "w / CAST(0.8 AS DOUBLE)"))
def q41_aspect_fit(spark, d):
    i = lambda c: F.col(c).cast("int")
    box = g.aspect_fit(i("l_partkey") % 1700, i("l_orderkey") % 900, i("l_quantity") * 9, F.col("l_linenumber") * 61, F.lit(1920), F.lit(1080))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, [{'x': l_partkey % 50, 'y': l_suppkey % 40}, {'x': l_orderkey % 60, 'y': l_partkey % 30}, {'x': l_suppkey % 70, 'y': l_orderkey % 20}, {'x': (l_partkey + l_orderkey) % 80, 'y': l_partkey % 10}] AS a FROM lineitem),
    s AS (SELECT l_orderkey, l_linenumber, list_sort(a) AS a FROM p), f AS (SELECT l_orderkey, l_linenumber, a, (a[1].y, a[1].x) <= (a[2].y, a[2].x) AS l, (a[3].y, a[3].x) <= (a[4].y, a[4].x) AS r FROM s)
    SELECT l_orderkey, l_linenumber, concat_ws(',', if(l, a[1].x, a[2].x), if(l, a[1].y, a[2].y), if(r, a[3].x, a[4].x), if(r, a[3].y, a[4].y), if(r, a[4].x, a[3].x), if(r, a[4].y, a[3].y), if(l, a[2].x, a[1].x), if(l, a[2].y, a[1].y)) AS corners FROM f""")
def q41b_corner_order(spark, d):
    p, o, s = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.array(point(p % 50, s % 40), point(o % 60, p % 30), point(s % 70, o % 20), point((p + o) % 80, p % 10))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", g.ordered_corners(points).alias("c"))
    flat = F.flatten(F.transform("c", lambda q: F.array(q["x"], q["y"])))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(flat.cast("array<string>"), ",").alias("corners"))


@query("SELECT event_id, CAST((360 - event_id % 4 * 90) % 360 AS INTEGER) AS turn FROM events")
def q42_upright(spark, d):
    return table(spark, d, "events").select("event_id", g.upright((F.col("event_id") % 4 * 90).cast("int")).alias("turn"))


@query("""WITH m AS (SELECT user_id, median(value) AS angle FROM events GROUP BY user_id HAVING count(*) > 5)
    SELECT user_id, angle, abs(angle) > 5 AS rotate, CAST(trunc(480 * abs(sin(radians(angle))) + 640 * abs(cos(radians(angle)))) AS INTEGER) AS w, CAST(trunc(480 * abs(cos(radians(angle))) + 640 * abs(sin(radians(angle)))) AS INTEGER) AS h FROM m""")
def q42b_deskew(spark, d):
    found = boxes.median_angle(table(spark, d, "events"), "user_id", "value")
    return found.select("user_id", "angle", "rotate", g.rotated_canvas(F.lit(640), F.lit(480), F.col("angle")).alias("c")).select("user_id", "angle", "rotate", "c.*")


# --- frames -------------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS snapshot FROM events), b AS (SELECT snapshot, event_id, value FROM w QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY value DESC, event_id) = 1)
    SELECT snapshot, b.event_id, b.value, e.event_type FROM b JOIN events e USING (event_id)""")
def q28_sharpest(spark, d):
    events = table(spark, d, "events")
    rows = events.select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).cast("long").alias("snapshot"), "event_id", "value")
    best = frames.best_of(rows, ["snapshot"], "value", ["event_id"])
    return best.join(events.select("event_id", "event_type"), "event_id").select("snapshot", "event_id", "value", "event_type")


LAPLACE_SQL = "v[m(i - 1) * 8 + m(j) + 1] + v[m(i + 1) * 8 + m(j) + 1] + v[m(i) * 8 + m(j - 1) + 1] + v[m(i) * 8 + m(j + 1) + 1] - 4 * v[i * 8 + j + 1]"
for _inner in ("i - 1", "i + 1", "j - 1", "j + 1", "i", "j"):
    LAPLACE_SQL = LAPLACE_SQL.replace(f"m({_inner})", f"(7 - abs(7 - abs({_inner})))")


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings),
    k AS (SELECT vec_id, v, unnest(range(0, 64)) // 8 AS i, unnest(range(0, 64)) % 8 AS j FROM e), l AS (SELECT vec_id, {LAPLACE_SQL} AS l FROM k)
    SELECT vec_id, CAST(CAST(64 * sum(l * l) - sum(l) * sum(l) AS BIGINT) AS DOUBLE) / 64 / 64 / 64 AS sharpness FROM l GROUP BY vec_id""")
def q29_sharpness(spark, d):
    return table(spark, d, "embeddings").select("vec_id", frames.sharpness(vectors.quantised(F.col("embedding")), 8, 8).alias("sharpness"))


@query("""WITH c AS (SELECT user_id, trim(event_type) AS v, count(*) AS n, min(event_id) AS o FROM events WHERE trim(event_type) <> '' GROUP BY ALL)
    SELECT user_id, v AS winner, n AS votes FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o) = 1""")
def q30_majority(spark, d):
    return frames.majority(table(spark, d, "events"), "user_id", F.col("event_type"), "event_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS first FROM events WHERE event_type <> 'error' GROUP BY user_id")
def q30b_first_valid(spark, d):
    return frames.first_valid(table(spark, d, "events"), "user_id", F.expr("if(event_type = 'error', '', event_type)"), "event_id")


@query("SELECT event_id, CAST(event_id % 8 AS INTEGER) AS worker FROM events")
def q31_assigned(spark, d):
    return frames.assigned(table(spark, d, "events").select("event_id"), "event_id", 8)


SPACING = 6 * 3600


@query(f"""WITH RECURSIVE s AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    k AS (SELECT user_id, event_id, t AS last, rn, true AS ok FROM s WHERE rn = 1
          UNION ALL SELECT s.user_id, s.event_id, CASE WHEN s.t - last >= {SPACING} THEN s.t ELSE last END, s.rn, s.t - last >= {SPACING} FROM k JOIN s ON k.user_id = s.user_id AND s.rn = k.rn + 1)
    SELECT user_id, event_id FROM k WHERE ok""")
def q32_spacing(spark, d):
    return frames.spaced(table(spark, d, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "event_id", SPACING)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30")
def q33_keep_latest(spark, d):
    return frames.keep_latest(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 30).select("user_id", "event_id")


@query("SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS INTEGER) AS pull FROM events")
def q33b_micro_batches(spark, d):
    return frames.micro_batches(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 4).select("user_id", "event_id", "pull")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def q33c_latest_value(spark, d):
    return frames.latest_value(table(spark, d, "events"), "user_id", "value", ["event_id"])


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS moving_mean FROM events")
def q34_moving_mean(spark, d):
    rows = frames.moving_mean(table(spark, d, "events"), "user_id", "value", ["ts", "event_id"])
    return rows.select("event_id", F.round("moving_mean", 6).alias("moving_mean"))


@query("SELECT event_id, concat_ws(',', lag(event_id) OVER w, event_id) AS ring FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q34b_ring(spark, d):
    rows = frames.ring(table(spark, d, "events"), "user_id", "event_id", ["ts", "event_id"])
    return rows.select("event_id", F.array_join(F.col("ring").cast("array<string>"), ",").alias("ring"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS bottles, count(*) FILTER (event_type = 'view') AS bags, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM events GROUP BY user_id")
def q37_conditional_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("bottles"), F.count_if(F.col("event_type") == "view").alias("bags"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count("*").alias("total"))


@query("SELECT DISTINCT event_type AS kind FROM events UNION ALL SELECT DISTINCT l_returnflag FROM lineitem")
def q38_union(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("kind")).distinct().union(table(spark, d, "lineitem").select("l_returnflag").distinct())


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(1, least(trunc(48 * (l_quantity / (l_linenumber * 5))), 320)) AS INTEGER) AS w, CASE WHEN l_quantity * l_linenumber >= 1 THEN round(l_quantity * l_linenumber * 1.5 / (2 * (l_quantity + l_linenumber)), 6) END AS grow FROM lineitem")
def q44_text_crops(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", g.resized_width(q, n * 5).alias("w"), F.round(g.unclip_distance(q * n, 2 * (q + n)), 6).alias("grow"))


@query("""SELECT page_id, string_split(rtrim(url, '/'), '/')[-1] AS last_part, CASE WHEN trim(url) <> '' THEN trim(url) ELSE CAST(page_id AS VARCHAR) END AS name, page_id || ': ' || printf('%.4f', page_id / 8.0) AS label FROM pages""")
def q45_names(spark, d):
    url, page = F.col("url"), F.col("page_id").cast("string")
    return table(spark, d, "pages").select("page_id", strings.base_name(url).alias("last_part"), strings.one_name(url, page).alias("name"), strings.scored_label(page, F.col("page_id") / 8.0).alias("label"))


@query("SELECT user_id, round(avg(value), 6) AS mean_conf, count(*) AS blocks FROM events WHERE value >= 5 GROUP BY user_id")
def q46_mean_confidence(spark, d):
    kept = table(spark, d, "events").filter("value >= 5")
    return kept.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean_conf"), F.count("*").alias("blocks"))


@query("SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 100")
def q47_first_frames(spark, d):
    """A capture that stops after 100 frames: the limit is the feature."""
    return frames.first_rows(table(spark, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], 100)


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents),
    f AS (SELECT doc_id, w, min(p) AS p FROM w GROUP BY doc_id, w) SELECT doc_id, count(*) AS n_distinct, md5(string_agg(w, ' ' ORDER BY p)) AS words_md5 FROM f GROUP BY doc_id""")
def q48_ordered_distinct(spark, d):
    """The words of a text without repeats, in order of first appearance."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", strings.ordered_distinct(F.split("text", " ")).alias("words"))
    return docs.select("doc_id", F.size("words").cast("long").alias("n_distinct"), F.md5(F.array_join("words", " ").cast("binary")).alias("words_md5"))


# --- streams ------------------------------------------------------------------------------------------------------------


@query(ORACLE_SQL["q32_spacing"])
def q50_spacing_stream(spark, d):
    rows = states.spaced_stream(runs.event_stream(spark, d), "user_id", "seconds", "event_id", SPACING)
    return runs.drained(rows).select("user_id", "event_id")


@query("SELECT user_id, array_to_string(list_sort(list(event_id)), ',') AS held FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30) GROUP BY user_id")
def q51_latest_stream(spark, d):
    """Each micro-batch updates the buffers of its users; the last update of a user is the final one."""
    rows = states.latest_stream(runs.event_stream(spark, d), "user_id", "seconds", "event_id", 30)
    out = runs.drained(rows, "update", "user_id")
    return out.select("user_id", F.array_join(F.array_sort("held").cast("array<string>"), ",").alias("held"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_id AS best, value AS score FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
    QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY value DESC, event_id) = 1""")
def q52_best_per_window_stream(spark, d):
    """Closed windows only: the last ones stay open at the end of the input."""
    rows = states.best_per_window(runs.event_stream(spark, d), "ts", "value", "event_id", "1 hour", "10 minutes")
    return runs.drained(rows).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- the whole flow ---------------------------------------------------------------------------------------------------------


@query(f"""WITH q AS (SELECT DISTINCT {NOISY_SQL} AS text FROM part), {SCORED_SQL.split(",", 0)[0][SCORED_SQL.index("r AS"):]},
    best AS (SELECT text, name FROM k WHERE rank = 1), n AS (SELECT p_partkey, p_name, {NOISY_SQL} AS seen FROM part),
    e AS (SELECT DISTINCT l_orderkey, p_name AS item FROM lineitem JOIN n ON l_partkey = p_partkey),
    a AS (SELECT DISTINCT l_orderkey, best.name AS item FROM lineitem JOIN n ON l_partkey = p_partkey JOIN best ON seen = text WHERE l_returnflag <> 'R'),
    b AS (SELECT coalesce(e.l_orderkey, a.l_orderkey) AS batch, e.item AS ei, a.item AS ai FROM e FULL JOIN a ON e.l_orderkey = a.l_orderkey AND e.item = a.item)
    SELECT batch, coalesce(array_to_string(list_sort(list(ei) FILTER (ai IS NULL)), ','), '') AS only_registered, coalesce(array_to_string(list_sort(list(ai) FILTER (ei IS NULL)), ','), '') AS only_recognized,
           count(*) FILTER (ai IS NULL OR ei IS NULL) = 0 AS matched FROM b GROUP BY batch""")
def q60_recognise_and_reconcile(spark, d):
    part = table(spark, d, "part")
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    seen = F.when(F.col("l_returnflag") != "R", recognition.noisy(F.col("p_name"), F.col("p_partkey")))
    rows = lines.select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("item_id"), seen.alias("seen_text"))
    return recognition.reconciled(rows, part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name")))


@query(f"""WITH {SCORED_SQL}, m AS (SELECT text, array_to_string(list(name ORDER BY rank), ',') AS found FROM k GROUP BY text), a AS (SELECT array_to_string(list(name ORDER BY name), ',') AS every FROM r),
    s AS (SELECT q.text, found, every, CASE WHEN length(trim(q.text)) < 3 THEN 'empty_text' WHEN found IS NOT NULL THEN 'matched' ELSE 'all_names' END AS status FROM q LEFT JOIN m ON q.text = m.text, a)
    SELECT text, status, CASE status WHEN 'matched' THEN found WHEN 'all_names' THEN every ELSE '' END AS candidates FROM s""")
def q61_recognised_texts(spark, d):
    """Guard, candidates and fallback of every distinct recognised text."""
    found = recognition.recognised(_noisy(spark, d), table(spark, d, "part"), "text", "p_name")
    return found.select("text", "status", F.array_join("candidates", ",").alias("candidates"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q60_recognise_and_reconcile(spark, sf_dir)
