"""Registered queries of the operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamwatch.llm import bpe, collocations, decontaminate, divergence, langid, licenses, lines, mixing, neardup, pii, sharding, suffix, topk
from seamwatch.llm.common import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 of near equal bytes (law ``bytes``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keys = ["doc_id", "text"]
    slot_map = sharding.next_map(sharding.slot_bytes(docs, keys), 40, f"{new_folder(spark)}/maps")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    placed = sharding.assign(docs.withColumns({"size": sharding.record_bytes(), "text_crc32": F.crc32(raw)}), slot_map, keys).drop("text")
    numbered = sharding.number(placed, ["doc_id", "size", "text_crc32"], ["doc_id", "text_crc32"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


@register
def op9_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")


@register
def op2_bit_sliced_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each vector whose id is divisible by 50."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLES["op2_bit_sliced_top5"] = """
WITH v AS (
  SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.number, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.number <> b.number),
ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@register
def op5_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling of all documents to evened source, language and topic shares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, columns=["doc_id", "source", "lang"]).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "taken")


@register
def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shared", "n_item", "containment")


@register
def op4_bayesian_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a similarity of 0.8 of their two-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 2).drop("tag")


@register
def op3_perfect_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 code points in at least 5 documents stay in the largest doc_id alone."""
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents"), texts=False)


ORACLES["op3_perfect_hash_lines"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (
  SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AND k.doc_id <> f.owner AS dropped
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@register
def op8_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that also start in a document of smaller id, removed from all documents."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


@register
def op10_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents with their coverage and place."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op7_character_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: spans by the rules and those that the tagger adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_personal_data(docs, pii.train(docs))


ORACLES["op6_benchmark_containment"] = r"""
WITH it AS (
  SELECT min(item_id) AS item_id, list(item_id) AS ids, w FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) > 0 GROUP BY w),
si AS (SELECT item_id, w, least(len(w), 5) AS width FROM it),
s AS (
  SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM si)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY 1),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
d AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS g
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
        FROM dw, (SELECT DISTINCT width FROM s) k WHERE len(w) >= width)),
found AS (
  SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
  FROM d JOIN s USING (width, g) JOIN n USING (item_id)
  GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(n_item * 0.8))
SELECT doc_id, ids.item_id, n_shared, n_item, containment
FROM found JOIN (SELECT item_id AS least, unnest(ids) AS item_id FROM it) ids ON ids.least = found.item_id
"""


@register
def op11_count_level_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language and the 50 terms that each source has most above the language."""
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLES["op11_count_level_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
tok AS (
  SELECT row_id, lang, source,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
kept AS (
  SELECT lang, term, count(*) AS total FROM tok GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
vocabulary AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT lang, source, sum(n) AS n_all FROM c GROUP BY lang, source),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(s.n_all, 0) + 5 * v.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.total + 5)) // (v.all_n + 5 * v.v) AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN vocabulary v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN size s ON s.lang = g.lang AND s.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM cells WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@register
def op12_prefix_free_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language, counted in the distinct chunks of a prefix-free parse."""
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLES["op12_prefix_free_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM spots, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, phrase, max(m) AS m, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND f >= 100),
cuts AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, m, a, k, x.f AS l, y.f AS r, n,
         (CAST(1000 AS HUGEINT) * a * CAST(n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts
  JOIN (SELECT lang, phrase, f FROM f) x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN (SELECT lang, phrase, f FROM f) y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
  JOIN n ON n.lang = cuts.lang),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, a, m, j, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c WHERE m > 2))
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


@register
def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and the text decoded from them, as counts and digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=False)
