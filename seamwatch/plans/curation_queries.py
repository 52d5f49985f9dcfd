"""Queries over dataset records, splits, labels and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamwatch import adapters as A
from seamwatch import constants as K
from seamwatch import schemas as S
from seamwatch.functions import geometry as G
from seamwatch.functions import quality as Q
from seamwatch.functions import text as X
from seamwatch.operators import curation as D
from seamwatch.operators import neardup as N
from seamwatch.plans.registry import BITS_SQL, RECORDS_SQL, query
from seamwatch.skew import global_rank, number_rows
from seamwatch.sources import files as SRC

# --- duplicates and quality -----------------------------------------------------------------------------

_DUP_SQL = f"""{RECORDS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY lower(relative_path), relative_path) > 1 AS exact_duplicate,
  row_number() OVER (PARTITION BY perceptual_hash ORDER BY lower(relative_path), relative_path) > 1 AS seen FROM records),
flagged AS (SELECT *, seen AND NOT exact_duplicate AS near_duplicate FROM x)"""


@query(f"WITH {_DUP_SQL} SELECT relative_path, exact_duplicate, near_duplicate FROM flagged")
def dup_flags(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_flags(A.image_records(spark, d)).select("relative_path", "exact_duplicate", "near_duplicate")


_QC_SQL = f"""{_DUP_SQL}, qc AS (SELECT *, list_filter([
  CASE WHEN n_chars % 11 <> 0 AND (n_chars < 320 OR n_chars // 2 < 240) THEN 'low_resolution' END,
  CASE WHEN n_chars % 11 <> 0 AND (n_chars % 256 < 35 OR n_chars % 100 / 100 >= 0.55) THEN 'too_dark' END,
  CASE WHEN n_chars % 11 <> 0 AND (n_chars % 256 > 225 OR n_chars % 90 / 100 >= 0.55) THEN 'too_bright' END,
  CASE WHEN n_chars % 11 <> 0 AND n_chars % 200 < 80 THEN 'possibly_blurry' END,
  CASE WHEN n_chars % 11 = 0 THEN 'unreadable_image' END,
  CASE WHEN exact_duplicate THEN 'exact_duplicate' END, CASE WHEN near_duplicate THEN 'near_duplicate' END,
  CASE WHEN lang = 'en' THEN 'metadata_missing' END, CASE WHEN lang IN ('en', 'fr') THEN 'pose_missing' END], lambda f: f IS NOT NULL) AS flags FROM flagged)"""


def _quality_records(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    rows = D.duplicate_flags(A.image_records(spark, d))
    metric = Q.metric_flags(n, F.floor(n / 2), n % 256, (n % 100) / 100, (n % 90) / 100, n % 200, n % 11 != 0)
    flags = Q.all_flags(metric, F.col("exact_duplicate"), F.col("near_duplicate"), F.col("lang") == "en", F.col("lang").isin("en", "fr"))
    return rows.withColumn("qc_flags", flags)


@query(f"WITH {_QC_SQL} SELECT relative_path, array_to_string(flags, '|') AS qc_flags FROM qc")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return _quality_records(spark, d).select("relative_path", F.array_join("qc_flags", "|").alias("qc_flags"))


@query(f"WITH {_QC_SQL} SELECT flag, count(*) AS images FROM (SELECT unnest(flags) AS flag FROM qc) GROUP BY 1")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.flag_counts(_quality_records(spark, d))


@query(f"""WITH {_QC_SQL} SELECT relative_path, capture_id, batch_id, array_to_string(flags, '|') AS qc_flags FROM qc WHERE len(flags) > 0""")
def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = _quality_records(spark, d).withColumn("split", F.lit(None).cast("string"))
    return D.quality_issues(rows).drop("split")


# --- splits ---------------------------------------------------------------------------------------------------

_SPLIT_SQL = f"""{RECORDS_SQL},
grp AS (SELECT DISTINCT CASE WHEN lang <> 'en' THEN 'batch:' || batch_id ELSE 'capture:' || capture_id END AS g FROM records),
rk AS (SELECT g, row_number() OVER (ORDER BY sha256('{K.SPLIT_SEED}|' || g)) AS k, count(*) OVER () AS n FROM grp),
parts AS (SELECT *, CAST(floor(0.7 * n) AS BIGINT) AS a, CAST(floor(0.15 * n) AS BIGINT) AS b, 0.7 * n - floor(0.7 * n) AS ra, 0.15 * n - floor(0.15 * n) AS rb FROM rk),
al AS (SELECT *, n - a - 2 * b AS rest,
  (CASE WHEN rb > ra THEN 2 ELSE 0 END) AS pos_a, CASE WHEN rb > ra THEN 0 ELSE 1 END AS pos_v FROM parts),
sp AS (SELECT g, CASE WHEN k <= a + CASE WHEN pos_a < rest THEN 1 ELSE 0 END THEN 'train'
   WHEN k <= a + CASE WHEN pos_a < rest THEN 1 ELSE 0 END + b + CASE WHEN pos_v < rest THEN 1 ELSE 0 END THEN 'val' ELSE 'test' END AS split FROM al),
assigned AS (SELECT r.*, split FROM records r JOIN sp ON g = CASE WHEN lang <> 'en' THEN 'batch:' || batch_id ELSE 'capture:' || capture_id END)"""


def _split_records(spark: SparkSession, d: str) -> DataFrame:
    rows = A.image_records(spark, d).withColumn("batch_id", F.when(F.col("lang") != "en", F.col("batch_id")))
    return D.assign_splits(rows)


@query(f"WITH {_SPLIT_SQL} SELECT relative_path, split FROM assigned")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return _split_records(spark, d).select("relative_path", "split")


@query(f"WITH {_SPLIT_SQL} SELECT split, count(*) AS images FROM assigned GROUP BY 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.split_counts(_split_records(spark, d))


@query("""SELECT s AS split FROM (VALUES ('train'), ('val'), ('test')) v(s)
EXCEPT SELECT CASE WHEN n_chars > 100000000 THEN 'test' WHEN doc_id % 2 = 0 THEN 'train' ELSE 'val' END FROM documents""")
def empty_splits(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("n_chars") > 100_000_000, "test").when(F.col("doc_id") % 2 == 0, "train").otherwise("val")
    return D.empty_splits(A.table(spark, d, "documents").select(split.alias("split")))


@query("""SELECT coalesce(split, 'unassigned') AS split, count(*) AS images
FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM documents) GROUP BY 1""")
def split_coverage(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 2 == 0, "train").otherwise("val")
    return D.split_counts(A.table(spark, d, "documents").select(split.alias("split")))


@query("SELECT count(*) AS images_total, count(DISTINCT doc_id // 3) AS captures_total FROM documents")
def dataset_totals(spark: SparkSession, d: str) -> DataFrame:
    return D.dataset_totals(A.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("capture_id")))


@query("SELECT conv_id AS capture_id, count(*) AS frames FROM conversations GROUP BY 1 HAVING count(*) <> 3")
def odd_captures(spark: SparkSession, d: str) -> DataFrame:
    return D.odd_captures(A.table(spark, d, "conversations").select(F.col("conv_id").alias("capture_id")))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'val' WHEN doc_id % 11 = 0 THEN 'test' ELSE 'train' END AS split FROM documents""")
def configured_split(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents").select("doc_id")
    return D.configured_split(docs, docs.where("doc_id % 7 = 0"), docs.where("doc_id % 11 = 0"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 7 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 11 = 0")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents").select("doc_id")
    return D.split_overlap(docs.where("doc_id % 7 = 0"), docs.where("doc_id % 11 = 0"))


@query("SELECT doc_id + 500 AS doc_id FROM labels EXCEPT SELECT doc_id FROM documents")
def unknown_split_keys(spark: SparkSession, d: str) -> DataFrame:
    return D.unknown_split_keys(
        A.table(spark, d, "labels").select((F.col("doc_id") + 500).alias("doc_id")), A.table(spark, d, "documents").select("doc_id"))


@query("SELECT l_orderkey, min(l_linenumber) AS first_seen FROM lineitem GROUP BY 1")
def distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ordered distinct ids: each id once, with the place it was first seen."""
    return A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_seen"))


@query("""SELECT c_custkey, row_number() OVER (ORDER BY sha256(CAST(c_custkey AS VARCHAR))) AS position, count(*) OVER () AS total FROM customer""")
def hash_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("digest"))
    return global_rank(rows, "digest", "position", "total").drop("digest")


# --- near duplicates across splits --------------------------------------------------------------------------------

_PLACES = [f"CAST((vec_id * 7 + {13 * j}) % 64 AS INTEGER)" for j in range(5)]
_HI_FLIP = [f"CASE WHEN {j} < vec_id % 6 AND {p} < 32 THEN CAST(1 AS BIGINT) << greatest(0, 31 - {p}) ELSE 0 END" for j, p in enumerate(_PLACES)]
_LO_FLIP = [f"CASE WHEN {j} < vec_id % 6 AND {p} >= 32 THEN CAST(1 AS BIGINT) << least(31, 63 - {p}) ELSE 0 END" for j, p in enumerate(_PLACES)]


@query(f"""WITH {BITS_SQL}, both_ AS (SELECT vec_id, split, hi, lo FROM bits
  UNION ALL SELECT vec_id, 'scan', xor(hi, {' + '.join(_HI_FLIP)}), xor(lo, {' + '.join(_LO_FLIP)}) FROM bits),
c AS (SELECT split, hi, lo, count(*) AS n, min(vec_id) AS first_id FROM both_ GROUP BY 1, 2, 3)
SELECT a.first_id AS left_id, a.split AS left_split, a.n AS left_rows, b.first_id AS right_id, b.split AS right_split, b.n AS right_rows,
  CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance
FROM c a JOIN c b ON a.split < b.split AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 4""")
def near_dup_cross_split(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's sign bits, and a scan of it with none to five bits flipped, so pairs stand at all distances from 0 to 4."""
    own = A.sign_bits(spark, d).select(F.col("vec_id").alias("id"), "split", "hi", "lo")
    hi, lo = F.col("hi"), F.col("lo")
    for j in range(5):
        place = ((F.col("id") * 7 + 13 * j) % 64).cast("int")
        flipped = F.lit(j) < F.col("id") % 6
        hi = hi.bitwiseXOR(F.when(flipped & (place < 32), F.call_function("shiftleft", F.lit(1).cast("bigint"), 31 - place)).otherwise(F.lit(0).cast("bigint")))
        lo = lo.bitwiseXOR(F.when(flipped & (place >= 32), F.call_function("shiftleft", F.lit(1).cast("bigint"), 63 - place)).otherwise(F.lit(0).cast("bigint")))
    pairs = N.cross_split_pairs(own.unionByName(own.select("id", F.lit("scan").alias("split"), hi.alias("hi"), lo.alias("lo"))))
    return pairs.select(
        F.col("left_first_id").alias("left_id"), "left_split", "left_rows", F.col("right_first_id").alias("right_id"), "right_split", "right_rows", "distance")


_DOC_HASH = "('0x' || substr(sha256(regexp_replace(lower(text), '[^a-z]', '', 'g')), 1, 8))::BIGINT"


@query(f"""WITH h AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
   {_DOC_HASH} AS hi, xor({_DOC_HASH}, CAST(1 AS BIGINT) << CAST(doc_id % 5 AS INTEGER)) AS lo FROM documents),
c AS (SELECT split, hi, lo, count(*) AS n, min(doc_id) AS first_id FROM h GROUP BY 1, 2, 3)
SELECT a.first_id AS left_id, b.first_id AS right_id, a.n AS left_rows, b.n AS right_rows, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance
FROM c a JOIN c b ON a.split < b.split AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 4""")
def near_dup_documents(spark: SparkSession, d: str) -> DataFrame:
    """Copies of a text get hashes one or two bits apart, so real pairs exist at every scale."""
    digest = F.sha2(F.regexp_replace(F.lower("text"), "[^a-z]", ""), 256)
    half = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    flip = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("doc_id") % 5).cast("int"))
    m = F.col("doc_id") % 3
    rows = A.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.when(m == 0, "train").when(m == 1, "val").otherwise("test").alias("split"),
        half.alias("hi"), half.bitwiseXOR(flip).alias("lo"))
    pairs = N.cross_split_pairs(rows)
    return pairs.select(F.col("left_first_id").alias("left_id"), F.col("right_first_id").alias("right_id"), "left_rows", "right_rows", "distance")


@query("""WITH c AS (SELECT sha256(text) AS sha256, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2)
SELECT a.sha256, a.split AS left_split, b.split AS right_split, a.n AS left_rows, b.n AS right_rows, a.f AS left_first_id, b.f AS right_first_id
FROM c a JOIN c b ON a.sha256 = b.sha256 AND a.split < b.split""")
def content_dup_cross_split(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 3
    rows = A.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.when(m == 0, "train").when(m == 1, "val").otherwise("test").alias("split"))
    return N.content_duplicates(rows)


# --- labels --------------------------------------------------------------------------------------------------------

_BOX_SQL = """boxes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE l_returnflag WHEN 'A' THEN 'digital_meter' WHEN 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'tool_wrench' ELSE 'coal_pile' END ELSE 'dragon' END AS class,
  l_quantity - 5 AS x1, l_tax * 1000 AS y1, l_quantity + 20 AS x2, l_tax * 1000 + 30 AS y2 FROM lineitem),
cut AS (SELECT *, least(greatest(x1, 0), 64) AS a, least(greatest(y1, 0), 64) AS b, least(greatest(x2, 0), 64) AS c, least(greatest(y2, 0), 64) AS d FROM boxes),
judged AS (SELECT *, CASE WHEN class = 'dragon' THEN 'unknown' WHEN class = 'tool_wrench' THEN 'ignored' WHEN c <= a OR d <= b THEN 'invalid' ELSE 'kept' END AS outcome,
  CASE class WHEN 'coal_pile' THEN 0 ELSE 1 END AS idx FROM cut),
lined AS (SELECT *, CASE WHEN outcome = 'kept' THEN printf('%d %.8f %.8f %.8f %.8f', idx, (a + c) / 2.0 / 64, (b + d) / 2.0 / 64, (c - a) / 64, (d - b) / 64) END AS line FROM judged)"""
_CLASSES = '{"tool_wrench":{"id":"wrench","type":"tool","train":false},"coal_pile":{"id":"coal_pile"},"digital_meter":{"id":"digital_meter"}}'


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    classes = SRC.classes(spark.createDataFrame([(_CLASSES,)], "content string")).select("class", "class_index")
    flag = F.col("l_returnflag")
    name = F.when(flag == "A", "digital_meter").when(flag == "N", F.when(F.col("l_linestatus") == "F", "tool_wrench").otherwise("coal_pile")).otherwise("dragon")
    boxes = A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", name.alias("class"), F.lit(64).alias("width"), F.lit(64).alias("height"),
        G.box(F.col("l_quantity") - 5, F.col("l_tax") * 1000, F.col("l_quantity") + 20, F.col("l_tax") * 1000 + 30).alias("bbox"))
    return D.annotation_rows(boxes, classes), classes


@query(f"WITH {_BOX_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, outcome, line FROM lined")
def label_lines(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _labels(spark, d)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "outcome", "line")


@query(f"""WITH {_BOX_SQL} SELECT o_orderkey, coalesce(string_agg(line || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (outcome = 'kept'), '') AS text
FROM orders LEFT JOIN lined ON l_orderkey = o_orderkey GROUP BY 1""")
def label_texts(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _labels(spark, d)
    images = A.table(spark, d, "orders").select("o_orderkey")
    out = D.label_texts(rows.withColumnRenamed("l_orderkey", "o_orderkey"), images, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("o_orderkey", "text")


_DATASET_SQL = """r AS (SELECT o_orderkey, o_custkey % 5 <> 0 AS there, CASE o_custkey % 11 WHEN 0 THEN 'holdout' WHEN 1 THEN NULL WHEN 2 THEN 'val' WHEN 3 THEN 'test' ELSE 'train' END AS split,
  o_orderkey % 4 <> 0 AS labelled, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 64 END AS width FROM orders),
o AS (SELECT *, CASE WHEN NOT there THEN 'missing' WHEN split IS NULL OR split = 'holdout' THEN 'invalid_split' WHEN NOT labelled THEN 'skipped' WHEN width IS NULL THEN 'missing_size' ELSE 'converted' END AS outcome FROM r)"""


def _dataset(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_custkey") % 11
    split = F.when(n == 0, "holdout").when(n == 2, "val").when(n == 3, "test").when(n != 1, "train")
    rows = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", split.alias("split"), F.when(F.col("o_custkey") % 7 != 0, 64).alias("width"), F.lit(64).alias("height"))
    return D.dataset_images(rows, F.col("o_custkey") % 5 != 0, F.col("o_orderkey") % 4 != 0)


@query(f"WITH {_DATASET_SQL} SELECT o_orderkey, split, outcome FROM o")
def dataset_images(spark: SparkSession, d: str) -> DataFrame:
    return _dataset(spark, d).select("o_orderkey", "split", "outcome")


@query(f"""WITH {_DATASET_SQL}, c AS (SELECT unnest(['images', 'images', 'split', 'split', 'split', 'violation', 'violation', 'violation']) AS part,
  unnest(['converted', 'skipped_unlabelled', 'train', 'val', 'test', 'missing', 'invalid_split', 'missing_size']) AS name)
SELECT part, name, (SELECT count(*) FROM o WHERE CASE part WHEN 'split' THEN outcome = 'converted' AND split = name ELSE outcome = CASE name WHEN 'skipped_unlabelled' THEN 'skipped' ELSE name END END) AS images FROM c""")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return D.dataset_summary(_dataset(spark, d))


@query(f"""WITH {_BOX_SQL}, k(class) AS (VALUES ('tool_wrench'), ('coal_pile'), ('digital_meter'))
SELECT class, count(*) FILTER (outcome = 'kept') AS kept, count(*) FILTER (outcome = 'ignored') AS ignored FROM k LEFT JOIN lined USING (class) GROUP BY 1""")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    rows, classes = _labels(spark, d)
    return D.class_counts(rows, classes)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_quantity - 10 >= 0 THEN printf('%d %.6f %.6f %.6f %.6f', 0, (l_quantity - 10 + l_quantity + 10) / 2 / 60, 0.5, 20.0 / 60, 1.0) END AS line
FROM lineitem""")
def marker_lines(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    box = G.box(q - 10, F.lit(0.0), q + 10, F.lit(40.0))
    valid = F.when(G.inside_image(box, F.lit(60), F.lit(40)), box)
    return A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.label_line(F.lit(0), valid, F.lit(60), F.lit(40), clip=False).alias("line"))


# --- crops and manifests -----------------------------------------------------------------------------------------------

_BIG_SQL = """b AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS x1, CAST(round(l_tax * 1000) AS INTEGER) AS y1, CAST(l_quantity AS INTEGER) + CAST(l_partkey % 90 AS INTEGER) + 1 AS x2,
   CAST(round(l_tax * 1000) AS INTEGER) + 30 AS y2, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
big AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (x2 - x1) * (y2 - y1) DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS boxes FROM b) WHERE k = 1)"""


def _largest(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_quantity").cast("int"), F.round(F.col("l_tax") * 1000).cast("int")
    rows = A.table(spark, d, "lineitem").select(
        "l_orderkey", *A.OBJECT_ORDER, G.box(x, y, x + (F.col("l_partkey") % 90).cast("int") + 1, y + 30).alias("bbox"))
    return D.largest_boxes(rows, ["l_orderkey"], A.OBJECT_ORDER)


@query(f"WITH {_BIG_SQL} SELECT l_orderkey, x1, y1, x2, y2, boxes FROM big")
def largest_box(spark: SparkSession, d: str) -> DataFrame:
    return _largest(spark, d).select("l_orderkey", *[F.col(f"bbox.{s}").alias(s) for s in G.SIDES], "boxes")


@query(f"""WITH {_BIG_SQL}, p AS (SELECT *, CAST(greatest(2, round_even(greatest(x2 - x1, y2 - y1) * 0.08, 0)) AS INTEGER) AS pad FROM big)
SELECT l_orderkey, greatest(0, x1 - pad) AS x1, greatest(0, y1 - pad) AS y1, least(100, x2 + pad) AS x2, least(100, y2 + pad) AS y2,
  round_even(CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / 10000, 6) AS fraction FROM p""")
def expand_box(spark: SparkSession, d: str) -> DataFrame:
    big = _largest(spark, d)
    grown = G.expand_box(F.col("bbox"), F.lit(100), F.lit(100), K.CROP_PADDING)
    return big.select("l_orderkey", grown.alias("g"), G.area_fraction(F.col("bbox"), F.lit(100), F.lit(100)).alias("fraction")).select(
        "l_orderkey", *[F.col(f"g.{s}").alias(s) for s in G.SIDES], "fraction")


_CROP_SQL = """note AS (SELECT sha256(text) AS sha256, min(doc_id) % 10 + 1 AS old, min(doc_id) % 200 AS x1 FROM documents GROUP BY 1 HAVING min(doc_id) % 4 <> 3),
s AS (SELECT doc_id, sha256(text) AS sha256, doc_id % 10 + 1 AS label FROM documents),
m AS (SELECT s.*, old, x1, CASE WHEN note.sha256 IS NULL THEN 'no reviewed detector annotation matches' WHEN x1 + 40 > 220 THEN 'reviewed bbox is outside the image' END AS error FROM s LEFT JOIN note USING (sha256))"""


def _crops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = A.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 10 + 1).alias("label"), F.lit(220).alias("width"), F.lit(100).alias("height"))
    owner = docs.groupBy("sha256").agg(F.min("doc_id").alias("o")).where(F.col("o") % 4 != 3)
    x = (F.col("o") % 200).cast("int")
    notes = owner.select(F.upper("sha256").alias("sha256"), (F.col("o") % 10 + 1).alias("annotation_label"), G.box(x, F.lit(10), x + 40, F.lit(60)).alias("bbox"))
    return D.crop_boxes(D.match_annotations(docs, notes))


@query(f"""WITH {_CROP_SQL} SELECT doc_id, label, old AS annotation_label, old <> label AS label_corrected, CAST(greatest(0, x1 - 4) AS INTEGER) AS x1, CAST(least(220, x1 + 44) AS INTEGER) AS x2,
  CAST(least(220, x1 + 44) - greatest(0, x1 - 4) AS INTEGER) AS crop_width, CAST(58 AS INTEGER) AS crop_height FROM m WHERE error IS NULL""")
def crop_manifest(spark: SparkSession, d: str) -> DataFrame:
    good, _ = _crops(spark, d)
    return good.select("doc_id", "label", "annotation_label", "label_corrected", F.col("crop.x1").alias("x1"), F.col("crop.x2").alias("x2"), "crop_width", "crop_height")


@query(f"WITH {_CROP_SQL} SELECT doc_id, error FROM m WHERE error IS NOT NULL")
def crop_skipped(spark: SparkSession, d: str) -> DataFrame:
    return _crops(spark, d)[1].select("doc_id", "error")


_MARK_SQL = """mk AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN label < 8 THEN label + 1 END AS station_number, CASE WHEN vec_id % 5 = 0 THEN 'manual' ELSE 'model' END AS src FROM embeddings)"""


def _marker(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("vec_id") % 3
    base = A.table(spark, d, "embeddings").select(
        "vec_id", "label", F.when(m == 0, "train").when(m == 1, "val").otherwise("test").alias("split"),
        F.when(F.col("vec_id") % 5 == 0, "manual").otherwise("model").alias("annotation_source"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    side = (F.col("vec_id") % 50 + 10).cast("int")
    positives = base.where("label < 8").withColumn("station_number", F.col("label") + 1).withColumn(
        "bboxes", F.array(G.box(F.lit(0), F.lit(0), side, F.lit(20)), G.box(F.lit(1), F.lit(1), F.lit(11), F.lit(11))))
    return D.marker_manifest(positives.drop("label"), base.where("label >= 8").drop("label"))


@query(f"""WITH {_MARK_SQL} SELECT vec_id, CASE WHEN station_number IS NULL THEN 'negative' ELSE 'positive' END AS label,
  CAST(CASE WHEN station_number IS NULL THEN 0 ELSE 2 END AS INTEGER) AS boxes, CASE WHEN station_number IS NOT NULL THEN round_even((vec_id % 50 + 10) * 20 / 10000.0, 6)::DOUBLE END AS first_fraction FROM mk""")
def marker_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _marker(spark, d).select("vec_id", "label", F.size("bboxes").alias("boxes"), F.get("bbox_area_fractions", F.lit(0)).alias("first_fraction"))


@query(f"""WITH {_MARK_SQL} SELECT split, count(station_number) AS positives, count(*) - count(station_number) AS negatives, count(*) FILTER (src = 'manual') AS manual,
{", ".join(f"count(*) FILTER (station_number = {n}) AS label_{n}" for n in range(1, 11))} FROM mk GROUP BY 1""")
def label_matrix(spark: SparkSession, d: str) -> DataFrame:
    return D.label_matrix(_marker(spark, d))


# --- scans ------------------------------------------------------------------------------------------------------------------

@query("""SELECT doc_id, source AS station_id, n_chars AS width FROM documents WHERE doc_id % 6 NOT IN (4, 5)""")
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    good, _ = SRC.parse_manifest(_manifest_lines(spark, d), S.IMAGE_RECORD)
    return good.select(F.col("capture_id").cast("bigint").alias("doc_id"), "station_id", F.col("width").cast("bigint").alias("width"))


def _manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 6
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("capture_id"), F.col("source").alias("station_id"), F.col("n_chars").alias("width"), F.lit("b").alias("batch_id")))
    return A.table(spark, d, "documents").select("doc_id", F.when(m == 4, "  ").when(m == 5, F.concat(F.lit("["), line)).otherwise(line).alias("line"))


@query("SELECT doc_id, 'malformed manifest line' AS message FROM documents WHERE doc_id % 6 = 5")
def manifest_errors(spark: SparkSession, d: str) -> DataFrame:
    _, bad = SRC.parse_manifest(_manifest_lines(spark, d), S.IMAGE_RECORD)
    return bad.select("doc_id", "message")


@query("""SELECT sha256(text) AS sha256, count(*) AS rows FROM documents WHERE doc_id % 9 <> 0 GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT NULL, count(*) FROM documents WHERE doc_id % 9 = 0 HAVING count(*) > 0""")
def keyed_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.upper(F.sha2("text", 256))).otherwise(" ").alias("sha256"))
    return SRC.keyed_manifest(rows)[1]


@query("""SELECT doc_id FROM documents WHERE doc_id % 7 < 4 AND doc_id % 5 <> 2""")
def image_discovery(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 7
    suffix = F.when(m == 0, ".JPG").when(m == 1, ".jpeg").when(m == 2, ".png").when(m == 3, ".bmp").when(m == 4, ".gif").when(m == 5, ".jpg.txt").otherwise("")
    folder = F.when(F.col("doc_id") % 5 == 2, "a/processed/b").otherwise("a/Processed/b")
    rows = A.table(spark, d, "documents").select("doc_id", F.concat(folder, F.lit("/img"), F.col("doc_id").cast("string"), suffix).alias("relative_path"))
    return SRC.discover_images(rows).select("doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 4) THEN 'one' WHEN doc_id % 6 = 2 THEN 'two' WHEN doc_id % 6 = 3 THEN 'dir' ELSE 'parent-' || doc_id END AS capture_id,
  CASE WHEN doc_id % 6 = 4 THEN 'cap' ELSE 'parent-' || doc_id END AS batch_id, doc_id % 6 = 5 AS metadata_missing FROM documents""")
def sidecar_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Sidecar priority: file (0, 1, 4; broken file sidecars fall through), stem (2), folder (3), none (5)."""
    n = F.col("doc_id")
    folder = F.concat(F.lit("/data/parent-"), n.cast("string"))
    docs = A.table(spark, d, "documents").select("doc_id", F.concat(folder, F.lit("/x.y.jpg")).alias("path"), folder.alias("folder"))
    def sidecar(rows: DataFrame, name: str, content):
        return rows.select(F.concat("folder", F.lit(f"/{name}")).alias("path"), content.alias("content"))
    m = n % 6
    sidecars = (
        sidecar(docs.where(m.isin(0, 1)), "x.y.jpg.metadata.json", F.lit('{"capture_id":"one","robot_pose":{"x_m":1}}'))
        .union(sidecar(docs.where(m == 4), "x.y.jpg.metadata.json", F.lit('{"capture_id":" one ","capture_batch":"cap"}')))
        .union(sidecar(docs.where(m.isin(2, 3)), "x.y.jpg.metadata.json", F.lit("not json")))
        .union(sidecar(docs.where(m.isin(1, 2)), "x.y.json", F.lit('{"capture_id":"two"}')))
        .union(sidecar(docs.where(m.isin(0, 1, 2, 3)), "metadata.json", F.lit('{"capture_id":"dir"}'))))
    out = SRC.image_records(SRC.attach_metadata(docs, sidecars))
    return out.select("doc_id", "capture_id", "batch_id", "metadata_missing")


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AS found FROM orders""")
def stored_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Stored captures fill in where no sidecar exists."""
    o = A.table(spark, d, "orders")
    images = o.select("o_orderkey", F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"), F.lit("/a.jpg")).alias("path"))
    stored = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("capture_id"), F.lit('{"station_id":"8"}').alias("metadata_json"))
    none = images.where("o_orderkey < 0").select("path", F.lit("{}").alias("content"))
    out = SRC.image_records(SRC.attach_metadata(images, none, stored))
    return out.select("o_orderkey", (F.col("station_id") == "8").eqNullSafe(F.lit(True)).alias("found"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'file' WHEN o_orderkey % 4 = 1 THEN 'stem' END AS class FROM orders WHERE o_orderkey % 4 < 2""")
def annotation_scan(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    base = F.concat(F.lit("/s/"), F.col("o_orderkey").cast("string"), F.lit("/p"))
    images = o.select("o_orderkey", F.concat(base, F.lit(".png")).alias("path"))
    def side(which, suffix, text):
        return o.where(which).select(F.concat(base, F.lit(suffix)).alias("path"), F.lit(text).alias("content"))
    m = F.col("o_orderkey") % 4
    sidecars = (side(m == 0, ".png.labels.json", '[{"class":"file","bbox_xyxy":[0,0,1,1]}]')
                .union(side(m < 2, ".labels.json", '[{"class":"stem","bbox_xyxy":[0,0,1,1]}]')).union(side(m == 2, ".labels.json", '{"class":"x"}')))
    boxes, _ = SRC.annotation_boxes(SRC.attach_annotations(images, sidecars), ["o_orderkey"])
    return boxes.select("o_orderkey", "class")


@query("""SELECT doc_id, CAST(doc_id % 10 + 1 AS INTEGER) AS label FROM documents WHERE doc_id % 13 <> 0""")
def labelled_samples(spark: SparkSession, d: str) -> DataFrame:
    return SRC.labelled_samples(*_labelled(spark, d))[0].select("doc_id", "label")


@query("""SELECT (doc_id % 10 + 1) || '/' || (doc_id % 9 + 1) || '_' || doc_id || '.jpg' AS relative_path, 'file number differs from its folder' AS violation
FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 10 <> doc_id % 9
UNION ALL SELECT 'gone/' || doc_id, 'excluded sample does not exist' FROM labels WHERE doc_id % 50 = 0""")
def labelled_sample_violations(spark: SparkSession, d: str) -> DataFrame:
    return SRC.labelled_samples(*_labelled(spark, d))[1]


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("doc_id")
    path = F.concat((n % 10 + 1).cast("string"), F.lit("/"), (n % 9 + 1).cast("string"), F.lit("_"), n.cast("string"), F.lit(".jpg"))
    files = A.table(spark, d, "documents").select("doc_id", path.alias("relative_path"))
    gone = A.table(spark, d, "labels").where("doc_id % 50 = 0").select(F.concat(F.lit("gone/"), n.cast("string")).alias("relative_path"))
    return files, files.where(n % 13 == 0).select("relative_path").union(gone)


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'configured text differs from the file name' ELSE 'reading must have 4 digits' END AS violation
FROM part WHERE p_size % 4 = 0 OR p_size % 4 = 1""")
def meter_sample_violations(spark: SparkSession, d: str) -> DataFrame:
    number = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    text = F.concat(F.lit("-"), F.substring(number, 1, 3), F.lit("."), F.substring(number, 4, 1), F.when(F.col("p_size") % 4 == 1, "7").otherwise(""))
    name = F.when(F.col("p_size") % 4 == 0, "other").otherwise(text)
    rows = A.table(spark, d, "part").select("p_partkey", text.alias("text"), F.concat(F.lit("m/"), name, F.lit(".jpg")).alias("path"))
    return SRC.labelled_meters(rows)[1].select("p_partkey", "violation")


@query("""SELECT page_id, row_number() OVER (ORDER BY page_id % 7, page_id) AS position FROM pages""")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Natural order of ``run<r>/IMG<n>``: ranked in sampled slices and shifted, never by a global window."""
    n = F.col("page_id")
    rows = A.table(spark, d, "pages").select("page_id", (n % 7).alias("run"), F.concat(F.lit("run"), (n % 7).cast("string"), F.lit("/IMG"), n.cast("string")).alias("name"))
    keyed = rows.withColumn("key", X.natural_key(F.col("name")))
    ranked = number_rows(keyed, [], ["key"], "position", slice_by="sampled", start=1)
    return ranked.select("page_id", F.col("position").cast("bigint").alias("position"))


@query("""SELECT doc_id, regexp_replace(regexp_replace('cap ' || doc_id || '!', '[^a-zA-Z0-9._-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') || '_img_' || substr(sha256(text), 1, 10) AS name
FROM documents""")
def sample_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    name = X.unique_sample_name(F.concat(F.lit("cap "), n, F.lit("!")), F.concat(F.lit("a/"), n, F.lit("/img.png")), F.sha2("text", 256))
    return A.table(spark, d, "documents").select("doc_id", name.alias("name"))
