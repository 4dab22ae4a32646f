"""Fixtures derived from the driver tables: corpora, predictions and experiment arms."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcube.functions.columns import hash32, hash_of
from gapcube.operators import cube as C
from gapcube.operators import splits as SP
from gapcube.session import written

# Fixed values of the fixtures: (system, seed, accuracy in percent) and (run, accuracy, scope) of each model.
SYSTEMS = [("sysA", "42", 70), ("sysA", "1", 70), ("sysA", "2", 70), ("sysB", "42", 60), ("sysB", "1", 60), ("sysZ", "0", 45)]
MODELS = [("mA", "42", 0), ("mA", "1", 0), ("mA", "2", 0), ("mB", "42", 4), ("mB", "1", 4)]
RUNS = [("id_random", 75, "R"), ("id_random_dedup", 74, "R"), ("id_random_fuzzydedup", 73, "R"), ("id_random_mask", 70, "R"),
        ("id_random_full", 77, "R"), ("id_temporal", 72, "T"), ("id_temporal_dedup", 71, "T"), ("loeo", 65, "A"),
        ("loeo_mask", 60, "A"), ("loeo_full", 67, "A"), ("chrono", 60, "E"), ("loeok", 61, "E"), ("loeon", 63, "S")]
CHRONO_MIN, CAP = 3000, 6000
MERGED = {"2-HIGH": "1-URGENT"}

_CACHE: dict[tuple, "Fixture"] = {}


def fixture(spark: SparkSession, sf_dir: str) -> "Fixture":
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _CACHE:
        _CACHE[key] = Fixture(spark, str(sf_dir))
    return _CACHE[key]


def forget() -> None:
    """Forget the stored tables (the bench calls this so that every query pays for its own inputs)."""
    _CACHE.clear()


def rows_sql(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


def struct_array(rows, names):
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A driver table."""
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- main corpus: orders of customers, nation = event, order priority = class; some cells thin or empty
    @cached_property
    def meta(self) -> DataFrame:
        o, c, n, r = (self.table(t) for t in ("orders", "customer", "nation", "region"))
        key = F.col("o_orderkey").cast("string")
        j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        keep = hash32("keep", key) % 16 < (F.col("n_nationkey") * 3 + F.substring("o_orderpriority", 1, 1).cast("int") * 5) % 17
        j = j.withColumn("classes", self.classes.scalar())
        return j.select(
            key.alias("item_id"), F.col("o_orderkey").alias("item_num"), F.col("n_name").alias("event"),
            F.col("r_name").alias("hazard"), thinned(keep, "o_orderpriority", F.col("n_nationkey")).alias("label"), F.col("o_orderdate").alias("posted_at"))

    @cached_property
    def classes(self) -> DataFrame:
        return C.class_list(self.table("orders").select(F.col("o_orderpriority").alias("label")))

    @cached_property
    def pred(self) -> DataFrame:
        return self.predictions(self.meta, SYSTEMS)

    def predictions(self, items: DataFrame, systems, carry=()) -> DataFrame:
        """Predictions of the listed systems for the items of the main corpus."""
        runs = struct_array([(m, s, a, f"{m}|{s}|", f"alt|{m}|{s}|") for m, s, a in systems], ("system", "seed", "acc", "key", "alt"))
        x = items.withColumn("classes", self.classes.scalar()).select(
            "item_id", "event", "label", "classes", *carry, F.explode(runs).alias("s"))
        hit = hash_of(F.concat("s.key", "item_id")) % 100 < F.col("s.acc")
        alt = F.element_at("classes", (hash_of(F.concat("s.alt", "item_id")) % F.size("classes") + 1).cast("int"))
        never = (F.col("s.system") == "sysZ") & (hash32("zero", F.col("event"), F.col("label")) % 4 == 0)  # cells that score zero
        other = F.element_at("classes", (F.array_position("classes", F.col("label")) % F.size("classes") + 1).cast("int"))
        return x.select("s.system", "s.seed", "item_id", "event", F.col("label").alias("y_true"),
                        F.when(never, other).when(hit, F.col("label")).otherwise(alt).alias("y_pred"), *carry)

    @cached_property
    def stored_pred(self) -> DataFrame:
        """The predictions as a stored table, as a run leaves them."""
        return written(self.pred, "pred")

    @cached_property
    def pairs(self) -> DataFrame:
        return written(C.pair_counts(self.pred), "pairs")

    @cached_property
    def cube(self) -> DataFrame:
        return written(C.cube_from_pairs(self.pairs, self.classes), "cube")

    @cached_property
    def features(self) -> DataFrame:
        return C.cell_features(self.cube)

    # --- time corpus: the events table, day = event
    @cached_property
    def tmeta(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").cast("string").alias("item_id"), F.col("event_id").alias("item_num"),
            F.date_format("ts", "yyyy-MM-dd").alias("event"), F.concat(F.lit("hz"), (F.dayofmonth("ts") % 4).cast("string")).alias("hazard"),
            F.col("event_type").alias("label"), F.col("ts").alias("posted_at"), F.dayofmonth("ts").alias("dom"))

    @cached_property
    def emeta(self) -> DataFrame:
        """The time corpus with thinned event-class cells, some of them empty; rows of thinned cells get another label."""
        keep = hash32("keep", F.col("item_id")) % 16 < (F.col("dom") * 3 + F.ascii("label") * 5) % 17
        names = self.tmeta.columns
        return self.tmeta.withColumn("classes", self.eclasses.scalar()).withColumn("label", thinned(keep, "label", F.col("dom"))).select(*names)

    @cached_property
    def eclasses(self) -> DataFrame:
        return C.class_list(self.tmeta.select("label"))

    @cached_property
    def splits(self) -> DataFrame:
        return written(SP.split_items(self.emeta), "splits")

    @cached_property
    def pools(self) -> DataFrame:
        return written(SP.chrono_pools(self.emeta), "pools")

    @cached_property
    def run_rows(self) -> DataFrame:
        """Predictions of every run of every model on the time corpus; not stored."""
        def specs(scope: str):
            rows = [(m, s, r, f"{r}|{m}|{s}|", f"alt|{r}|{m}|{s}|", a + d) for m, s, d in MODELS for r, a, sc in RUNS if sc == scope]
            return struct_array(rows, ("model", "seed", "run", "key", "alt", "acc"))
        x = self.splits.join(self.pools.select("event", "chrono_pool_n"), "event").withColumn("classes", self.eclasses.scalar())
        long = F.col("chrono_pool_n") >= CHRONO_MIN
        scopes = {"R": F.col("in_R"), "T": F.col("in_T"), "E": long, "S": long & (F.col("chrono_pool_n") < CAP)}
        wanted = F.concat(specs("A"), *[F.when(c, specs(n)).otherwise(F.slice(specs(n), 1, 0)) for n, c in scopes.items()])  # whole lists: no row filters a list
        x = x.select("item_id", "event", "label", "in_R", "in_T", "classes", F.explode(wanted).alias("s"))
        hit = hash_of(F.concat("s.key", "item_id")) % 100 < F.col("s.acc")
        alt = F.element_at("classes", (hash_of(F.concat("s.alt", "item_id")) % F.size("classes") + 1).cast("int"))
        x = x.select("s.model", "s.seed", "s.run", "item_id", "event", "in_R", "in_T", F.col("label").alias("y_true"),
                     F.when(hit, F.col("label")).otherwise(alt).alias("y_pred"))
        return x

    @cached_property
    def runs(self) -> DataFrame:
        """The same as a stored table, for queries that read rows more than once."""
        return written(self.run_rows, "runs")

    @cached_property
    def arms(self) -> DataFrame:
        """The arm cube counts the rows once, as they are made."""
        from gapcube.operators.estimands import arm_cube
        return written(arm_cube(self.run_rows, self.eclasses), "arms")

    # --- text corpora
    @cached_property
    def docs(self) -> DataFrame:
        from gapcube.operators.text import dedup_key
        return self.table("documents").select(
            F.col("doc_id").cast("string").alias("item_id"), F.col("doc_id").alias("item_num"), F.col("source").alias("event"),
            F.col("lang").alias("hazard"), "text", dedup_key("text").alias("text_norm"))

    @cached_property
    def dmeta(self) -> DataFrame:
        lab = self.table("labels").select(
            F.col("doc_id").cast("string").alias("item_id"),
            F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("label"))
        return self.docs.join(lab, "item_id")

    @cached_property
    def dpool(self) -> DataFrame:
        """(item_id, item_num, event) of the documents outside the random holdout; their texts are not read."""
        rows = self.docs.select("item_id", "item_num", "event")
        return written(rows.join(SP.random_holdout(rows).select("item_id"), "item_id", "left_anti"), "dpool")

    @cached_property
    def dsplit(self) -> DataFrame:
        """Documents with a random holdout flag."""
        r = SP.random_holdout(self.docs).select("item_id", F.lit(True).alias("r"))
        return written(self.docs.join(r, "item_id", "left").select(*self.docs.columns, F.coalesce("r", F.lit(False)).alias("in_R")), "dsplit")

    @cached_property
    def sims(self) -> DataFrame:
        from gapcube.operators.similarity import max_similarity
        return written(max_similarity(self.dsplit, 0.6), "sims")

    @cached_property
    def raw(self) -> DataFrame:
        """Labelled raw messages: some ids twice, some first copies empty, some without a label."""
        d = self.table("documents").join(self.table("labels"), "doc_id", "left")
        key = F.col("doc_id").cast("string")
        label = F.coalesce(F.concat(F.lit(" q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"), F.lit(" ")), F.lit(""))
        split = F.when(hash32("split", key) % 10 < 7, "train").when(hash32("split", key) % 10 < 8, "dev").otherwise("test")
        base = d.select(key.alias("item_id"), F.col("source").alias("event"), split.alias("split"), F.when(hash32("blank", key) % 7 == 0, "").otherwise(F.col("text")).alias("text_raw"),
                        label.alias("label"), F.col("doc_id").alias("source_order"), F.col("text").alias("whole"))
        again = base.filter(hash32("dup", F.col("item_id")) % 5 == 0).select("item_id", "event", "split", F.col("whole").alias("text_raw"), F.lit("other").alias("label"), (F.col("source_order") + 1000000000).alias("source_order"))
        return base.drop("whole").unionByName(again)

    @cached_property
    def canonical(self) -> DataFrame:
        """A canonical corpus with times decoded from ids."""
        from gapcube.operators.text import build_canonical, id_to_time
        c = build_canonical(self.raw)
        num = F.col("item_id").cast("bigint")
        snow = F.shiftleft(num * 1000003, 22) + num
        return c.select("*", num.alias("item_num"), id_to_time(snow).cast("timestamp_ntz").alias("posted_at"))

    @cached_property
    def run_tree(self) -> str:
        """Prediction files below <root>/confirm/orders/<system>/seed<seed>/loeo__all."""
        from gapcube.session import scratch_path
        from gapcube.sources.io import write_predictions
        root = scratch_path(self.spark, "runs")
        names = self.classes.head()[0]
        # the part of a class score that no run changes is drawn once per item; scores are plain columns, not arrays
        draws = [f"_d{i}" for i in range(len(names))]
        items = self.meta.select("item_id", "event", "label", *[(hash32("p", F.col("item_id"), c) % 1000).alias(d) for c, d in zip(names, draws)])
        items = written(items, "items")
        for spec in SYSTEMS:
            x = self.predictions(items, [spec], draws)
            scores = [(F.col(d) + F.when(F.col("y_pred") == c, 1000).otherwise(0)) / 1000.0 for c, d in zip(names, draws)]
            x = x.select("item_id", "event", "y_true", "y_pred", *[s.alias(d) for s, d in zip(scores, draws)])
            top = F.greatest(*draws) if len(draws) > 1 else F.col(draws[0])
            x = x.select("item_id", "event", "y_true", "y_pred", *[F.exp(F.col(d) - top).alias(d) for d in draws])
            total = reduce(lambda a, d: a + F.col(d), draws, F.lit(0.0))
            x = x.select("item_id", "event", "y_true", "y_pred", *[(F.col(d) / total).alias(f"p_{c}") for c, d in zip(names, draws)])
            write_predictions(x, names, f"{root}/confirm/orders/{spec[0]}/seed{spec[1]}/loeo__all")
        return root


def thinned(keep, label: str, event):
    """The label of a kept row; others get the class that is the event's own by number, so no row is lost."""
    return F.when(keep, F.col(label)).otherwise(F.element_at("classes", (event % F.size("classes") + 1).cast("int")))


def scores_of(classes: str):
    """Class scores of an item: a hash per class, plus one for the predicted class."""
    return F.transform(F.col(classes), lambda c: (hash32("p", F.col("item_id"), c) % 1000 + F.when(c == F.col("y_pred"), 1000).otherwise(0)) / 1000.0)


# --- the same fixtures as SQL common table expressions
def H(*parts: str) -> str:
    return "CAST(('0x' || substr(md5(" + " || '|' || ".join(parts) + "),1,8)) AS BIGINT)"


META = f"""classes AS MATERIALIZED (SELECT label AS cls, row_number() OVER (ORDER BY label) - 1 AS ci, count(*) OVER () AS k FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)),
meta AS MATERIALIZED (
  SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderkey AS item_num, n_name AS event, r_name AS hazard,
         CASE WHEN {H("'keep'", "CAST(o_orderkey AS VARCHAR)")} % 16 < (n_nationkey * 3 + CAST(substr(o_orderpriority,1,1) AS INT) * 5) % 17 THEN o_orderpriority ELSE own.cls END AS label, o_orderdate AS posted_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN classes own ON own.ci = n_nationkey % own.k)"""

PRED = META + f""",
pred AS MATERIALIZED (
  SELECT s.system, s.seed, m.item_id, m.event, m.label AS y_true,
         CASE WHEN s.system = 'sysZ' AND {H("'zero'", 'm.event', 'm.label')} % 4 = 0 THEN nx.cls WHEN {H('s.system', 's.seed', 'm.item_id')} % 100 < s.acc THEN m.label ELSE c.cls END AS y_pred
  FROM meta m CROSS JOIN (VALUES {rows_sql(SYSTEMS)}) AS s(system, seed, acc)
  JOIN classes c ON c.ci = {H("'alt'", 's.system', 's.seed', 'm.item_id')} % c.k
  JOIN classes lb ON lb.cls = m.label JOIN classes nx ON nx.ci = (lb.ci + 1) % lb.k)"""


def cube_sql(name: str, pred: str, classes: str, keys: str) -> str:
    """Counts by the definition: compare every row with every class of its level."""
    return f"""{name} AS MATERIALIZED (
  SELECT {keys}, event, cls,
         CAST(count(*) FILTER (y_true = cls AND y_pred = cls) AS BIGINT) AS tp,
         CAST(count(*) FILTER (y_true <> cls AND y_pred = cls) AS BIGINT) AS fp,
         CAST(count(*) FILTER (y_true = cls AND y_pred <> cls) AS BIGINT) AS fn
  FROM {pred} CROSS JOIN {classes} GROUP BY {keys}, event, cls)"""


CUBE = PRED + ",\n" + cube_sql("cube", "pred", "classes", "system, seed")

TMETA = """tmeta AS MATERIALIZED (
  SELECT CAST(event_id AS VARCHAR) AS item_id, event_id AS item_num, strftime(ts, '%Y-%m-%d') AS event,
         'hz' || CAST(day(ts) % 4 AS VARCHAR) AS hazard, event_type AS label, ts AS posted_at, day(ts) AS dom FROM events)"""
EMETA = TMETA + f""",
eclasses AS MATERIALIZED (SELECT label AS cls, row_number() OVER (ORDER BY label) - 1 AS ci, count(*) OVER () AS k FROM (SELECT DISTINCT label FROM tmeta)),
emeta AS MATERIALIZED (SELECT t.* REPLACE (CASE WHEN {H("'keep'", 'item_id')} % 16 < (dom * 3 + ascii(label) * 5) % 17 THEN label ELSE own.cls END AS label) FROM tmeta t JOIN eclasses own ON own.ci = dom % own.k)"""


def split_sql(meta: str, name: str = "splits") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT * EXCLUDE (nr, r_rank, t_rank), r_rank <= ceil(nr * 0.2::DOUBLE) AS in_R, t_rank <= ceil(nr * 0.2::DOUBLE) AS in_T FROM (
    SELECT *, count(*) OVER (PARTITION BY event) AS nr,
           row_number() OVER (PARTITION BY event ORDER BY {H("'R'", "'20260928'", 'item_id')}, item_num) AS r_rank,
           row_number() OVER (PARTITION BY event ORDER BY posted_at DESC, item_num DESC) AS t_rank FROM {meta}))"""


def pools_sql(meta: str, name: str = "pools") -> str:
    return f"""ev_{name} AS (SELECT event, count(*) AS n, min(posted_at) AS first_post FROM {meta} GROUP BY event),
{name} AS MATERIALIZED (
  SELECT e.event, e.n, e.first_post, count(DISTINCT m.event) AS n_source_events, count(m.item_id) AS chrono_pool_n
  FROM ev_{name} e LEFT JOIN {meta} m ON m.posted_at < e.first_post AND m.event <> e.event GROUP BY ALL)"""


WS = r"\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}"


def strip_sql(x):
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def norm_sql(x):
    return strip_sql(f"regexp_replace(regexp_replace({x}, 'http[^{WS}]+', '[URL]', 'g'), '@[\\p{{L}}\\p{{N}}_]+', '[USER]', 'g')")


def key_sql(x):
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({norm_sql(x)}), '^rt[{WS}]+\\[user\\]:?[{WS}]*', ''), '\\[url\\]|\\[user\\]', ' ', 'g'), '[^a-z0-9#]+', ' ', 'g'))"


DOCS = f"""docs AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS item_id, doc_id AS item_num, source AS event, lang AS hazard, text, {key_sql('text')} AS text_norm FROM documents)"""
DMETA = DOCS + """,
dmeta AS MATERIALIZED (SELECT d.*, 'q' || quality || 't' || toxic AS label FROM docs d JOIN labels l ON CAST(l.doc_id AS VARCHAR) = d.item_id)"""
DSPLIT = DOCS + f""",
dsplit AS MATERIALIZED (SELECT * EXCLUDE (nr, rk), rk <= ceil(nr * 0.2::DOUBLE) AS in_R FROM (SELECT *, count(*) OVER (PARTITION BY event) AS nr,
  row_number() OVER (PARTITION BY event ORDER BY {H("'R'", "'20260928'", 'item_id')}, item_num) AS rk FROM docs))"""
RAW = f"""base AS (SELECT CAST(d.doc_id AS VARCHAR) AS item_id, source AS event, CASE WHEN {H("'split'", 'CAST(d.doc_id AS VARCHAR)')} % 10 < 7 THEN 'train' WHEN {H("'split'", 'CAST(d.doc_id AS VARCHAR)')} % 10 < 8 THEN 'dev' ELSE 'test' END AS split,
  CASE WHEN {H("'blank'", 'CAST(d.doc_id AS VARCHAR)')} % 7 = 0 THEN '' ELSE text END AS text_raw, coalesce(' q' || quality || 't' || toxic || ' ', '') AS label, d.doc_id AS source_order, text AS whole FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
raw AS MATERIALIZED (SELECT item_id, event, split, text_raw, label, source_order FROM base UNION ALL SELECT item_id, event, split, whole, 'other', source_order + 1000000000 FROM base WHERE {H("'dup'", 'item_id')} % 5 = 0)"""
CANON = RAW + f""",
canon AS MATERIALIZED (SELECT item_id, CAST(item_id AS BIGINT) AS item_num, event, split, trim(label) AS label, {norm_sql('text_raw')} AS text, {key_sql('text_raw')} AS text_norm,
  CASE WHEN regexp_matches(text_raw, '^RT[{WS}]+@') THEN 1 ELSE 0 END AS is_retweet, epoch_ms(CAST(item_id AS BIGINT) * 1000003 + 1288834974657) AS posted_at
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY source_order) AS rn FROM raw WHERE text_raw <> '' AND trim(label) <> '') WHERE rn = 1)"""
RUNS_SQL = EMETA + ",\n" + split_sql("emeta") + ",\n" + pools_sql("emeta") + f""",
runs AS MATERIALIZED (
  SELECT s.model, s.seed, s.run, x.item_id, x.event, x.in_R, x.in_T, x.label AS y_true,
         CASE WHEN {H('s.run', 's.model', 's.seed', 'x.item_id')} % 100 < s.acc THEN x.label ELSE c.cls END AS y_pred
  FROM splits x JOIN pools p USING (event)
  JOIN (VALUES {rows_sql([(m, s, r, a + d, sc) for m, s, d in MODELS for r, a, sc in RUNS])}) AS s(model, seed, run, acc, scope)
    ON s.scope = 'A' OR (s.scope = 'R' AND x.in_R) OR (s.scope = 'T' AND x.in_T)
       OR (s.scope = 'E' AND p.chrono_pool_n >= {CHRONO_MIN})
       OR (s.scope = 'S' AND p.chrono_pool_n >= {CHRONO_MIN} AND p.chrono_pool_n < {CAP})
  JOIN eclasses c ON c.ci = {H("'alt'", 's.run', 's.model', 's.seed', 'x.item_id')} % c.k)"""
