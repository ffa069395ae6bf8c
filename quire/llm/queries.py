"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_density, neardup, packing, pii, prefix_trie, quality, runs, secret_scan, substring, token_counts, topk
from .store import table


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def unigram_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_density.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, unigram_path()).select("doc_id", "n_pretokens", "n_tokens")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


#: From this score a document is predicted to have label 1.
KEEP_SCORE = 0.7


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted")
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), 85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe_path())


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe_path(), "decoded")
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def tiled(docs: DataFrame) -> DataFrame:
    """docs in which one text in ten repeats p of its words from word a on to its end; both follow from a hash of
    doc_id. Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))
    docs = docs.withColumn("w", F.when(h % 10 == 0, words)).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    docs = docs.withColumn("p", F.floor((F.col("n") - F.col("a")) / (g % 8 + 3)) + 1)
    text = F.array_join(F.expr("transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)]))"), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(tiled(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # the greatest exponent first: a/b > c/d as a*d > c*b
    before = "CASE WHEN x.length * y.period <> y.length * x.period THEN IF(x.length * y.period > y.length * x.period, -1, 1) WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1) ELSE IF(x.period < y.period, -1, 1) END"
    found = found.withColumn("best", F.expr(f"aggregate(runs, named_struct('start', -1L, 'length', -1L, 'period', 1L), (x, y) -> IF({before} < 0, x, y))"))
    some = F.size("runs") > 0
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.when(some, F.col("best")[c]).alias(c) for c in ("start", "length", "period")),
        F.when(some, F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period"))).alias("exponent_milli"),
        F.sha2(F.when(some, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2_pii that SQL can express: base spans."""
    return op2_pii(spark, sf_dir).drop("spans")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_secrets that SQL can express: base spans."""
    return op6_secrets(spark, sf_dir).drop("spans")


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9_quality that SQL can express: which documents are held out, scores within 0 and 1 and the
    predictions that follow from them."""
    found = op9_quality(spark, sf_dir)
    sound = F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= KEEP_SCORE).cast("int"))
    return found.select("doc_id", "held_out", sound.alias("sound"))


def packing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_packing that SQL can express: the pieces of each document cover it once, within sequences of 2048."""
    pieces = op10_packing(spark, sf_dir)
    whole = (F.sum("length") == F.max("doc_tokens")) & (F.max(F.col("start") + F.col("length")) == F.max("doc_tokens")) & (F.countDistinct("start") == F.count("*"))
    inside = F.max(F.col("offset") + F.col("length")) <= 2048
    return pieces.groupBy("doc_id").agg((whole & inside & (F.min("start") == 0) & (F.min("length") > 0)).alias("covered"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_pii": op2_pii,
        "op3_substring": op3_substring,
        "op4_topk": op4_topk,
        "op5_token_counts": op5_token_counts,
        "op6_secrets": op6_secrets,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_decontaminate": op8_decontaminate,
        "op9_quality": op9_quality,
        "op10_packing": op10_packing,
        "op11_bpe": op11_bpe,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_runs": op13_runs,
        "pii_base": pii_base,
        "secrets_base": secrets_base,
        "quality_folds": quality_folds,
        "packing_documents": packing_documents,
    }


_SPACED = r"regexp_extract_all({0}, '[^\x09-\x0D\x20]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3_SQL = f"""
WITH t AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (g) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM each ANTI JOIN cover USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

_OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP7_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
least AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_OP8_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
m AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_OP12_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), i)) AS t),
b AS (SELECT DISTINCT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS s FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(list_reduce(s, lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h FROM b, crc),
own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS w FROM conversations GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(p.w, [])[1:h], o.w[h + 1:]) AS w FROM own o JOIN h USING (conv_id) LEFT JOIN own p ON p.conv_id = o.conv_id - o.conv_id % 5),
x AS (SELECT conv_id, len(w) AS size, d AS depth, w[1:d] AS k FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM r)),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends,
  (count(*) - 1) * coalesce(strlen(k[-1].text), 0) AS saved FROM x GROUP BY k, depth),
c AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (k)),
u AS (SELECT v.k, sum(d.saved) AS saved_tokens, count(*) FILTER (d.n_children = 0) AS n_leaves FROM (SELECT *, k[1:unnest(range(0, depth + 1))] AS above FROM f) d JOIN f v ON v.k = d.above GROUP BY v.k)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u USING (k) LEFT JOIN n p ON f.depth > 0 AND p.k = f.k[1:f.depth - 1]
"""


def _base_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """SQL of base spans: kinds give the pattern and the condition on a match x."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS gaps FROM t" for rank, (kind, (p, _)) in enumerate(kinds.items())
    )
    keep = " ".join(f"WHEN '{kind}' THEN {c}" for kind, (_, c) in kinds.items())
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    zero = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)
    before = "coalesce(list_sum(list_transform({0}, lambda y: length(y))), 0)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT *, unnest(m) AS x, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT doc_id, kind, rank, x, CAST({before.format("gaps[1:i]")} + {before.format("m[1:i - 1]")} AS BIGINT) AS a FROM e WHERE CASE kind {keep} END),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || (a + length(x)), ',' ORDER BY a, rank, length(x)) AS base FROM s GROUP BY doc_id)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256 FROM t LEFT JOIN g USING (doc_id)
"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_PII_SQL = _base_sql(
    {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR CAST('0' || left(ltrim(y, '0'), 4) AS INT) > 255)) = 0"),
        "card": (
            r"[0-9](?:[\x20-]?[0-9])+",
            f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CAST(reverse({_DIGITS})[i] AS INT) * (2 - i % 2) - 9 * CAST(CAST(reverse({_DIGITS})[i] AS INT) * (2 - i % 2) > 9 AS INT))) % 10 = 0",
        ),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
    }
)
_SECRETS_SQL = _base_sql(
    {
        "assign": (_ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(x, '{_ASSIGN}([A-Za-z0-9+/_.=-]+)', 1)) >= 6"),
        "access": ("AKIA[A-Z0-9]+", "length(x) >= 20"),
        "hex": ("[0-9a-f]+", "length(x) >= 24"),
    }
)
_FOLDS_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), i)) AS t),
b AS (SELECT doc_id, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS s FROM documents)
SELECT doc_id, xor(list_reduce(s, lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 4 = 2 AS held_out, true AS sound FROM b, crc
"""


def oracle_sql() -> dict[str, str]:
    parts = {"pii_base": _PII_SQL, "secrets_base": _SECRETS_SQL, "quality_folds": _FOLDS_SQL, "packing_documents": "SELECT doc_id, true AS covered FROM documents"}
    return parts | {"op12_prefix_trie": _OP12_SQL, "op3_substring": _OP3_SQL, "op4_topk": _OP4_SQL, "op7_near_duplicates": _OP7_SQL, "op8_decontaminate": _OP8_SQL}
