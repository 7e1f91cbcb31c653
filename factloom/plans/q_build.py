"""Corpus build (Entry A): abstracts ⋈ facts → grounding (G1–G7) → year
inference (V4, J7) → shape validation (V1–V3) → seeded sample (O1) → exact
split (O2–O4) → k-folds (O5, O6).  Counters A12/A13, joins J1–J3.

Abstracts are derived from the same customer rows as the facts: a sentence
with the label (sometimes lower-cased or left out), nation (left out for
key % 5 = 0), segment, first order date in prose, and sometimes the last
order year — so grounding has hits and misses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import grounding as GR
from factloom.operators.ordering import row_index
from factloom.operators.validation import conforming_entities, infer_years, inferred_years, shape_report
from factloom.plans.catalog import query
from factloom.plans.oracle import with_facts
from factloom.session import cut_lineage
from factloom.sources.derived import SHAPE, entity_facts, entity_rows, long_triples, shape_df

SEED = "42"
SAMPLE_N = 10000
SPLIT = (0.6, 0.8)
K = 5


def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = entity_rows(spark, sf_dir)
    k = F.col("ex_id")
    label = (F.when(k % 6 == 0, F.lit("This customer")).when(k % 4 == 0, F.lower("c_name"))
             .otherwise(F.col("c_name")))
    last = F.when((k % 3 == 0) & (F.year("last_order") != F.year("first_order")),
                  F.concat(F.lit(", the last one in "), F.year("last_order").cast("string"))).otherwise(F.lit(""))
    text = F.concat(label, F.lit(" is a customer"),
                    F.when(k % 5 != 0, F.concat(F.lit(" from "), F.col("n_name"))).otherwise(F.lit("")),
                    F.lit(" in the "), F.lower("c_mktsegment"),
                    F.lit(" segment. Their first order was placed on "),
                    F.date_format("first_order", "MMMM d, yyyy"), last, F.lit("."))
    return r.select("ex_id", text.alias("abstract"))


ABS_CTE = """
abs AS (SELECT ex_id, (CASE WHEN ex_id % 6 = 0 THEN 'This customer' WHEN ex_id % 4 = 0 THEN lower(c_name)
          ELSE c_name END) || ' is a customer' || (CASE WHEN ex_id % 5 <> 0 THEN ' from ' || n_name ELSE '' END)
          || ' in the ' || lower(c_mktsegment) || ' segment. Their first order was placed on '
          || strftime(first_order, '%B %-d, %Y')
          || (CASE WHEN ex_id % 3 = 0 AND year(last_order) <> year(first_order)
                   THEN ', the last one in ' || CAST(year(last_order) AS VARCHAR) ELSE '' END) || '.' AS abstract
        FROM ent),
dts AS (SELECT ex_id, abstract, list_distinct(list_filter(list_concat(
          list_transform(regexp_extract_all(abstract, '(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}'), lambda x: strftime(try_strptime(x, '%B %d, %Y'), '%Y-%m-%d')),
          list_transform(regexp_extract_all(abstract, '[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4}'), lambda x: strftime(try_strptime(x, '%d %B %Y'), '%Y-%m-%d')),
          list_transform(regexp_extract_all(abstract, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), lambda x: strftime(try_strptime(x, '%Y-%m-%d'), '%Y-%m-%d'))),
          lambda d: d IS NOT NULL)) AS dates FROM abs),
gr AS (SELECT f.ex_id, f.s, f.p, f.o, f.dt,
          CASE WHEN f.dt = 'xsd:date' THEN (CASE WHEN list_contains(d.dates, f.o) THEN f.o END)
               WHEN f.dt = 'xsd:gYear' THEN (CASE WHEN len(list_filter(d.dates, lambda x: substr(x, 1, 4) = f.o)) > 0
                                                  THEN f.o END)
               ELSE (CASE WHEN contains(lower(d.abstract), lower(f.o))
                            OR contains(strip_accents(lower(d.abstract)), strip_accents(lower(f.o))) THEN f.o END)
          END AS kept
        FROM facts f JOIN dts d ON f.ex_id = d.ex_id WHERE f.p <> 'type')"""


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ex_id, s, p, o, dt, kept) for every non-type fact (J1 on ex_id)."""
    facts = long_triples(entity_facts(spark, sf_dir)).where(F.col("p") != "type")
    ab = abstracts(spark, sf_dir).withColumn("dates", GR.extract_dates(F.col("abstract")))
    j = facts.join(ab, "ex_id", "inner")
    return j.select("ex_id", "s", "p", "o", "dt",
                    GR.grounded_value(F.col("abstract"), F.col("dates"), F.col("o"), F.col("dt")).alias("kept"))


@query("g1_g6_grounding", with_facts("SELECT ex_id, p, o, kept FROM gr", ABS_CTE))
def g1_g6_grounding(spark, sf_dir):
    """G1–G6 (+G3 date extraction, J1 join of facts and abstracts)."""
    return grounded(spark, sf_dir).select("ex_id", "p", "o", "kept")


@query("a12_property_counters", with_facts(
    "SELECT p, count(*) AS n_present, count(kept) AS n_grounded, count(*) - count(kept) AS n_not_grounded "
    "FROM gr GROUP BY p", ABS_CTE))
def a12_property_counters(spark, sf_dir):
    g = grounded(spark, sf_dir)
    return g.groupBy("p").agg(F.count(F.lit(1)).alias("n_present"), F.count("kept").alias("n_grounded"),
                              F.count_if(F.col("kept").isNull()).alias("n_not_grounded"))


def kept_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounded facts that are kept, checkpointed: the corpus, its years, its shape
    report and its counts read them a dozen times, and each time would be the joins
    of ``grounded`` again, their sorts held side by side in one task."""
    return cut_lineage(grounded(spark, sf_dir).where(F.col("kept").isNotNull()))


def corpus_base(kept: DataFrame) -> DataFrame:
    """Grounded facts of entities keeping ≥1 fact (G7) plus their type
    triple.  For the V4 path to be exercised, the year facts of key % 7 = 0
    are withheld."""
    g = kept.where(~((F.col("ex_id") % 7 == 0) & (F.col("p") == "firstOrderYear")))
    g = g.select("ex_id", "s", "p", F.col("kept").alias("o"), "dt")
    keep = g.select("ex_id", "s").distinct()
    typed = keep.select("ex_id", "s", F.lit("type").alias("p"), F.lit("Customer").alias("o"),
                        F.lit(None).cast("string").alias("dt"))
    return g.unionByName(typed)


def corpus_triples(kept: DataFrame) -> DataFrame:
    """Corpus triples with years inferred from dates where missing (V4)."""
    return infer_years(corpus_base(kept), "firstOrderDate", "firstOrderYear")


CORPUS_CTES = ABS_CTE + """,
g0 AS (SELECT ex_id, s, p, kept AS o, dt FROM gr
       WHERE kept IS NOT NULL AND NOT (ex_id % 7 = 0 AND p = 'firstOrderYear')),
gt AS (SELECT ex_id, s, p, o, dt FROM g0
       UNION ALL SELECT DISTINCT ex_id, s, 'type', 'Customer', CAST(NULL AS VARCHAR) FROM g0),
added AS (SELECT d.ex_id, d.s, 'firstOrderYear' AS p, substr(d.o, 1, 4) AS o, 'xsd:gYear' AS dt FROM gt d
          WHERE d.p = 'firstOrderDate' AND NOT EXISTS (SELECT 1 FROM gt y WHERE y.ex_id = d.ex_id
                                                       AND y.p = 'firstOrderYear')),
ct AS (SELECT * FROM gt UNION ALL SELECT * FROM added)"""


@query("v4_j7_year_inference", with_facts("SELECT ex_id, p, o FROM added", CORPUS_CTES))
def v4_j7_year_inference(spark, sf_dir):
    """V4 via J7 (left-anti): years added for entities with a date and no year."""
    return inferred_years(corpus_base(kept_facts(spark, sf_dir)), "firstOrderDate", "firstOrderYear").select("ex_id", "p", "o")


def _shape_values_sql() -> str:
    rows = []
    for path, dt, mn, mx, _k, grp, br in SHAPE:
        rel = path.split(":")[-1]
        f = lambda v: "NULL" if v is None else str(v)
        rows.append(f"('{path}', '{rel}', '{dt}', {f(mn)}, {f(mx)}, {f(grp)}, {f(br)})")
    return ("(SELECT * FROM (VALUES " + ", ".join(rows) +
            ") t(path, relation, datatype, min_count, max_count, or_group, or_branch))")


REPORT_CTES = CORPUS_CTES + f""",
sh AS {_shape_values_sql()},
ents AS (SELECT DISTINCT ex_id FROM ct),
rep AS (SELECT e.ex_id, s.path, s.or_group, s.or_branch, s.min_count, s.max_count,
               count(c.o) AS n,
               count(c.o) FILTER (WHERE (s.datatype = 'xsd:date' AND NOT (regexp_full_match(c.o, '-?[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
                                   AND try_strptime(c.o, '%Y-%m-%d') IS NOT NULL))
                                  OR (s.datatype = 'xsd:gYear' AND NOT regexp_full_match(c.o, '-?[0-9]{{4,}}'))) AS n_bad
        FROM ents e CROSS JOIN sh s LEFT JOIN ct c ON c.ex_id = e.ex_id AND c.p = s.relation
        GROUP BY e.ex_id, s.path, s.or_group, s.or_branch, s.min_count, s.max_count),
repf AS (SELECT *, CASE WHEN n_bad > 0 THEN 'datatype' WHEN min_count IS NOT NULL AND n < min_count THEN 'minCount'
                        WHEN max_count IS NOT NULL AND n > max_count THEN 'maxCount' END AS failed_rule FROM rep),
plain AS (SELECT ex_id, bool_and(failed_rule IS NULL) AS ok FROM repf WHERE or_group IS NULL GROUP BY ex_id),
br AS (SELECT ex_id, or_group, or_branch, bool_and(failed_rule IS NULL) AS ok FROM repf
       WHERE or_group IS NOT NULL GROUP BY ex_id, or_group, or_branch),
grp AS (SELECT ex_id, bool_and(g_ok) AS ok FROM (SELECT ex_id, or_group, bool_or(ok) AS g_ok FROM br
        GROUP BY ex_id, or_group) GROUP BY ex_id),
conf AS (SELECT e.ex_id, coalesce(p.ok, true) AND coalesce(g.ok, true)
                AND EXISTS (SELECT 1 FROM ct t WHERE t.ex_id = e.ex_id AND t.p = 'type' AND t.o = 'Customer')
                AS conforms
         FROM ents e LEFT JOIN plain p ON e.ex_id = p.ex_id LEFT JOIN grp g ON e.ex_id = g.ex_id)"""


def report(spark, sf_dir) -> DataFrame:
    ct = corpus_triples(kept_facts(spark, sf_dir))
    return shape_report(ct.select("ex_id", "p", "o"), shape_df(spark))


def conformance(kept: DataFrame) -> DataFrame:
    spark, ct = kept.sparkSession, corpus_triples(kept)
    # read twice, for plain paths and for branches
    rep = cut_lineage(shape_report(ct.select("ex_id", "p", "o"), shape_df(spark)))
    typed = ct.where((F.col("p") == "type") & (F.col("o") == "Customer")).select("ex_id").distinct()
    c = conforming_entities(rep)
    return c.join(typed.withColumn("_t", F.lit(True)), "ex_id", "left").select(
        "ex_id", (F.col("conforms") & F.coalesce(F.col("_t"), F.lit(False))).alias("conforms"))


@query("v2_shape_violations", with_facts(
    "SELECT ex_id, path, n, failed_rule FROM repf WHERE failed_rule IS NOT NULL", REPORT_CTES))
def v2_shape_violations(spark, sf_dir):
    """V2: which path failed which rule (J3: broadcast shape join)."""
    return report(spark, sf_dir).where(F.col("failed_rule").isNotNull()).select("ex_id", "path", "n", "failed_rule")


@query("v1_v3_conformance", with_facts("SELECT ex_id, conforms FROM conf", REPORT_CTES))
def v1_v3_conformance(spark, sf_dir):
    return conformance(kept_facts(spark, sf_dir))


@query("g7_a13_funnel", with_facts(
    "SELECT (SELECT count(*) FROM ent) AS n_entities, "
    "(SELECT count(*) FROM abs WHERE length(abstract) > 5 AND NOT contains(abstract, '{{') "
    "AND NOT contains(abstract, '}}')) AS n_abstract_ok, "
    "(SELECT count(DISTINCT ex_id) FROM gr WHERE kept IS NOT NULL) AS n_grounded, "
    "(SELECT count(*) FROM conf WHERE conforms) AS n_conforming", REPORT_CTES))
def g7_a13_funnel(spark, sf_dir):
    """A13 one-pass funnel counts, G7 keep-rule, P8 abstract filter."""
    ab = abstracts(spark, sf_dir)
    a = ab.agg(F.count(F.lit(1)).alias("n_entities"),
               F.count_if((F.length("abstract") > 5) & ~F.contains("abstract", F.lit("{{"))
                          & ~F.contains("abstract", F.lit("}}"))).alias("n_abstract_ok"))
    kept = kept_facts(spark, sf_dir)
    g = kept.agg(F.countDistinct("ex_id").alias("n_grounded"))
    c = conformance(kept).agg(F.count_if("conforms").alias("n_conforming"))
    # three one-row aggregates side by side: a join of single rows
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(a).join(one(g), "_k").join(one(c), "_k").drop("_k")


def sample_and_split(spark, sf_dir, sample: int | None = None) -> DataFrame:
    """O2 exact 60/20/20 split of the conforming entities in seeded order; with
    ``sample`` of the first so many of them (O1)."""
    conf = conformance(kept_facts(spark, sf_dir)).where("conforms").select("ex_id")
    h = F.md5(F.concat(F.lit(SEED), F.lit("Customer_"), F.col("ex_id").cast("string")))
    top = conf.withColumn("h", h)
    top = cut_lineage(top if sample is None else top.orderBy("h").limit(sample))
    ranked = row_index(top, [], ["h"], out="rank")
    n = top.agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    r = ranked.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k").drop("_k")
    split = (F.when(F.col("rank") < F.floor(SPLIT[0] * F.col("n")), F.lit("train"))
             .when(F.col("rank") < F.floor(SPLIT[1] * F.col("n")), F.lit("validation")).otherwise(F.lit("test")))
    return r.select("ex_id", split.alias("split"), "rank")


_TOP = f"SELECT ex_id, md5('{SEED}' || 'Customer_' || CAST(ex_id AS VARCHAR)) AS h FROM conf WHERE conforms"
SPLIT_CTES = REPORT_CTES + f""",
top AS ({_TOP}),
rk AS (SELECT ex_id, row_number() OVER (ORDER BY h) - 1 AS rank, count(*) OVER () AS n FROM top),
sp AS (SELECT ex_id, CASE WHEN rank < floor({SPLIT[0]} * n) THEN 'train' WHEN rank < floor({SPLIT[1]} * n)
                     THEN 'validation' ELSE 'test' END AS split, rank FROM rk)"""


@query("o1_o2_sample_split", with_facts(
    "SELECT ex_id, split, rank FROM sp", SPLIT_CTES.replace(_TOP, f"{_TOP} ORDER BY h LIMIT {SAMPLE_N}")))
def o1_o2_sample_split(spark, sf_dir):
    """O1: a seeded sample (the limit is the feature), split."""
    return sample_and_split(spark, sf_dir, SAMPLE_N)


@query("o2_split", with_facts("SELECT ex_id, split, rank FROM sp", SPLIT_CTES))
def o2_split(spark, sf_dir):
    """O2: every conforming entity, split."""
    return sample_and_split(spark, sf_dir)


@query("o3_test_sample", with_facts(
    "SELECT ex_id, rank FROM sp WHERE split = 'test' ORDER BY rank LIMIT 20", SPLIT_CTES))
def o3_test_sample(spark, sf_dir):
    """O3: the first 20 test rows (a sampling operator: the limit is the feature)."""
    return sample_and_split(spark, sf_dir).where("split = 'test'").orderBy("rank").limit(20).select("ex_id", "rank")


@query("o4_split_caps", with_facts(
    "SELECT ex_id, split FROM (SELECT ex_id, split, row_number() OVER (PARTITION BY split ORDER BY rank) - 1 AS r "
    "FROM sp) WHERE (split = 'train' AND r < 5000) OR (split = 'validation' AND r < 300) "
    "OR (split = 'test' AND r < 300)", SPLIT_CTES))
def o4_split_caps(spark, sf_dir, caps=(("train", 5000), ("validation", 300), ("test", 300))):
    """First-N caps per split (the feature), rank order within the split."""
    s = sample_and_split(spark, sf_dir)
    r = row_index(s, ["split"], ["rank"], out="r")
    cap = F.coalesce(*[F.when(F.col("split") == name, n) for name, n in caps])
    return r.where(F.col("r") < cap).select("ex_id", "split")


def kfold_of(i, n, k: int = K):
    """O5 contiguous folds: the first n mod k folds get one extra row."""
    q = F.floor(n / k)
    m = n - q * k
    big = m * (q + 1)
    return F.when(i < big, F.floor(i / (q + 1))).otherwise(m + F.floor((i - big) / q)).cast("int")


@query("o5_kfold_contiguous", with_facts(
    "SELECT ex_id, CAST(f AS INTEGER) AS fold, CASE WHEN f = own THEN 'test' ELSE 'train' END AS role FROM ("
    "SELECT ex_id, CASE WHEN i < m * (q + 1) THEN floor(i / (q + 1)) ELSE m + floor((i - m * (q + 1)) / q) END"
    f" AS own FROM (SELECT ex_id, i, floor(n / {K}) AS q, n - floor(n / {K}) * {K} AS m FROM ("
    "SELECT ex_id, row_number() OVER (ORDER BY rank) - 1 AS i, count(*) OVER () AS n FROM sp WHERE split = 'train')))"
    f" CROSS JOIN range({K}) r(f)",
    SPLIT_CTES))
def o5_kfold_contiguous(spark, sf_dir):
    """k = 5 contiguous folds over the train split in the split's shuffled
    order; a row is tested in its own fold and trained on in the others.  Train
    ranks are the first of all, so the rank is the row's place."""
    tr = cut_lineage(sample_and_split(spark, sf_dir).where("split = 'train'").select("ex_id", "rank"))
    n = tr.agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    j = tr.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")  # one row
    own = j.select("ex_id", kfold_of(F.col("rank"), F.col("n")).alias("own"))
    each = own.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(K)])))
    return each.select("ex_id", "fold", F.when(F.col("fold") == F.col("own"), "test").otherwise("train").alias("role"))


@query("o6_stratified_kfold",
       f"SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % {K} AS INTEGER)"
       " AS fold FROM labels")
def o6_stratified_kfold(spark, sf_dir):
    """O6 + X3: class-balanced folds (label column as the extractor)."""
    from factloom.sources.tables import table
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    r = row_index(lab, ["quality"], ["doc_id"], out="r")
    return r.select("doc_id", "quality", (F.col("r") % K).cast("int").alias("fold"))
