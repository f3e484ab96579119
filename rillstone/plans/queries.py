"""Registered queries over the driver's tables, and DuckDB SQL that gives the same rows.

Stand-ins: an event's item is `props.k`; a purchase is a payment, a user id divisible by 3 is
premium; a catalogue title is a part's name (an item's title that of the part with its key).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.hashing import PRIME, bands_and_rows, bloom_size, minhash_parameters, row_seed
from rillstone.operators import cache, prefix, ranking, running, similarity, sketches
from rillstone.sources import generators, scratch
from rillstone.sources.tables import parsed_events, sequenced, table
from rillstone.streaming import streams

from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = 86400
SETTINGS = pipeline.Settings(cache_capacity=20, bloom_capacity=500_000, bloom_error=0.001, bucket=DAY)
WIDTH, DEPTH = 1000, 5
BITS, HASHES = bloom_size(1000, 0.01)
CACHE = 20
CAPACITIES = [5, 10, 20, 50, 80]
PREFIXES = ["blue", "Re", "s", "", "zzz"]

EVENTS = """ev AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id, ts, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS item FROM events)"""


def query(sql: str | None = None, ctes: str = EVENTS) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return keep


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_events(table(spark, sf_dir, "events"))


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequenced(table(spark, sf_dir, "events"))


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequence(spark, sf_dir).filter("event_type = 'view'").select("seq", "item", "event_id", "user_id", "ts", "event_type")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_size").alias("popularity"), F.col("p_partkey").alias("seq"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("item"), F.col("p_name").alias("title"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (item, user) of all events."""
    return similarity.members(_events(spark, sf_dir), "item", "user_id")


def _premium() -> Column:
    return F.col("user_id") % 3 == 0


def _kind() -> Column:
    return F.when(F.col("event_type") == "purchase", "payment").otherwise(F.col("event_type"))


_CORE = "CASE WHEN event_type = 'purchase' THEN 0 WHEN user_id % 3 = 0 THEN 1 ELSE 2 END"


# -- priorities and order ---------------------------------------------------------------------


def _prioritized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequence(spark, sf_dir).withColumn("priority", ranking.core_priority(_kind(), _premium()))


@query(f"SELECT event_id, {_CORE} AS priority, CASE {_CORE} WHEN 0 THEN 'PAGO' WHEN 1 THEN 'PREMIUM' ELSE 'ESTÁNDAR' END AS label FROM events", ctes="")
def priority_core(spark, sf_dir):
    priority = ranking.core_priority(_kind(), _premium())
    return _events(spark, sf_dir).select("event_id", priority.alias("priority"), ranking.priority_label(priority).alias("label"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 4 WHEN user_id % 3 = 0 AND event_type = 'view' THEN 3
    WHEN event_type = 'click' THEN 2 ELSE 1 END AS priority FROM events""",
    ctes="",
)
def priority_graded(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "play").when(F.col("event_type") == "click", "search").otherwise(_kind())
    return _events(spark, sf_dir).select("event_id", ranking.graded_priority(kind, _premium()).alias("priority"))


@query(f"SELECT event_id, {_CORE} AS priority, row_number() OVER (ORDER BY {_CORE}, ts, seq) AS position FROM ev")
def priority_drain(spark, sf_dir):
    return ranking.drained(_prioritized(spark, sf_dir)).select("event_id", "priority", "position")


@query(f"SELECT event_id, {_CORE} AS priority FROM ev ORDER BY {_CORE}, ts, seq LIMIT 10")
def queue_preview(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("priority", ranking.core_priority(_kind(), _premium()))
    return ranking.first_served(rows, 10, seq="event_id").select("event_id", "priority")


@query(f"SELECT event_id, {_CORE} AS priority FROM ev ORDER BY {_CORE}, ts, seq LIMIT 1")
def queue_peek(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("priority", ranking.core_priority(_kind(), _premium()))
    return ranking.first_served(rows, 1, seq="event_id").select("event_id", "priority")


@query("SELECT event_id, seq AS depth FROM ev")
def queue_position(spark, sf_dir):
    """The queue's size after each push, which is the event's number while nothing is popped."""
    return _sequence(spark, sf_dir).select("event_id", F.col("seq").alias("depth"))


@query(
    """SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN -1 ELSE 1 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM events""",
    ctes="",
)
def queue_depth_by_user(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("order", F.struct("ts", "event_id"))
    return running.queue_depth(rows, F.when(F.col("event_type") == "signup", -1).otherwise(1), "order", ["user_id"]).select("event_id", "depth")


_DRAINED = f"SELECT event_id, row_number() OVER (ORDER BY {_CORE}, ts, event_id) AS position FROM ev"


@query(f"SELECT structure, count(*) AS served, CAST(sum(position * (event_id % 1009)) AS BIGINT) AS checksum FROM ({_DRAINED}), (VALUES ('quantile bins'), ('other bins')) s(structure) GROUP BY structure")
def queue_consistency(spark, sf_dir):
    """Two ways to drain the queue, by different bins and keys, serve every event at the same position."""
    one = ranking.drained(_prioritized(spark, sf_dir)).select(F.lit("quantile bins").alias("structure"), "event_id", "position")
    rows = _events(spark, sf_dir).withColumn("priority", ranking.core_priority(_kind(), _premium()))
    two = ranking.numbered(rows, F.unix_micros("ts"), ["ts", "event_id"], "position", lead=["priority"], bins=37).select(F.lit("other bins").alias("structure"), "event_id", "position")
    return one.union(two).groupBy("structure").agg(F.count("*").alias("served"), F.sum(F.col("position") * (F.col("event_id") % 1009)).alias("checksum"))


_GRADED = "CASE WHEN event_type = 'purchase' THEN 4 WHEN user_id % 3 = 0 AND event_type = 'view' THEN 3 WHEN event_type = 'click' THEN 2 ELSE 1 END"


@query(f"SELECT event_id, {_GRADED} AS priority, row_number() OVER (ORDER BY {_GRADED} DESC, seq) AS position FROM ev")
def priority_graded_drain(spark, sf_dir):
    """The second queue: the highest priority first, then the first that came."""
    kind = F.when(F.col("event_type") == "view", "play").when(F.col("event_type") == "click", "search").otherwise(_kind())
    rows = _sequence(spark, sf_dir).withColumn("priority", ranking.graded_priority(kind, _premium()))
    return ranking.drained_graded(rows).select("event_id", "priority", "position")


@query("SELECT seq, event_id FROM ev ORDER BY seq DESC LIMIT 12")
def recent_events(spark, sf_dir):
    return _sequence(spark, sf_dir).select("seq", "event_id").orderBy(F.desc("seq")).limit(12)


# -- counts -----------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type", ctes="")
def event_types(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))  # one row


@query("SELECT count(*) FILTER (user_id % 3 = 0) AS premium, count(*) FILTER (user_id % 3 <> 0) AS standard, round(avg(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS premium_share FROM (SELECT DISTINCT user_id FROM events)", ctes="")
def user_split(spark, sf_dir):
    users = _events(spark, sf_dir).select("user_id").distinct()
    return users.agg(F.count_if(_premium()).alias("premium"), F.count_if(~_premium()).alias("standard"), F.round(F.avg(_premium().cast("double")), 6).alias("premium_share"))


@query("SELECT split_part(p_name, ' ', 1) AS genre, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, genre LIMIT 5", ctes="")
def top_genres(spark, sf_dir):
    return ranking.top_k(table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("genre")), "genre", 5)


@query("SELECT item, count(*) AS n FROM ev GROUP BY item ORDER BY n DESC, min(seq) LIMIT 20")
def exact_top_k(spark, sf_dir):
    return ranking.top_k(_sequence(spark, sf_dir), "item", 20, seq="seq")


@query("SELECT round(avg(n), 6) AS mean_size, round(stddev_samp(n), 6) AS deviation FROM (SELECT item, count(DISTINCT user_id) AS n FROM ev GROUP BY item)")
def audience_sizes(spark, sf_dir):
    sizes = _sets(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"))
    return sizes.agg(F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.stddev_samp("n"), 6).alias("deviation"))


@query("SELECT event_id, substr(coalesce(json_extract_string(props, '$.q'), 'str'), 1, 3) AS query, CASE WHEN event_type IN ('view', 'click') THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS item FROM events", ctes="")
def event_details(spark, sf_dir):
    """A default for what an event lacks, its first three characters, and an item for some types alone."""
    events = table(spark, sf_dir, "events")
    text = F.substring(F.coalesce(F.get_json_object("props", "$.q"), F.lit("str")), 1, 3)
    item = F.when(F.col("event_type").isin("view", "click"), F.get_json_object("props", "$.k").try_cast("int"))
    return events.select("event_id", text.alias("query"), item.alias("item"))


# -- catalogue and prefixes -------------------------------------------------------------------

_CATALOGUE = """cat AS (SELECT lower(p_name) AS key, arg_max(p_name, p_partkey) AS title, CAST(sum(p_size) AS BIGINT) AS popularity
  FROM part GROUP BY lower(p_name))"""


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.catalogue(_titles(spark, sf_dir))


@query("SELECT * FROM cat", _CATALOGUE)
def catalogue_popularity(spark, sf_dir):
    return _catalogue(spark, sf_dir)


@query("SELECT count(*) AS titles FROM cat", _CATALOGUE)
def title_count(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.countDistinct(F.lower("p_name")).alias("titles"))


@query("SELECT title, popularity FROM cat WHERE starts_with(key, 're') ORDER BY popularity DESC, key LIMIT 10", _CATALOGUE)
def autocomplete(spark, sf_dir):
    return prefix.autocomplete(_catalogue(spark, sf_dir), "Re").select("title", "popularity")


@query("SELECT title, popularity FROM cat ORDER BY popularity DESC, key LIMIT 10", _CATALOGUE)
def autocomplete_all(spark, sf_dir):
    """The empty prefix: all titles, or none."""
    found = _catalogue(spark, sf_dir)
    return prefix.autocomplete(found, "").unionByName(prefix.autocomplete(found, "", empty_is_all=False)).select("title", "popularity")


@query("SELECT p_name AS title FROM part WHERE starts_with(p_name, 'blue') ORDER BY p_name LIMIT 10", ctes="")
def autocomplete_ordered(spark, sf_dir):
    return prefix.autocomplete_ordered(_titles(spark, sf_dir), "blue").select("title")


@query(
    """SELECT prefix, rank, title, popularity FROM (
    SELECT substr(key, 1, n) AS prefix, title, popularity, row_number() OVER (PARTITION BY substr(key, 1, n) ORDER BY popularity DESC, key) AS rank
    FROM (SELECT *, unnest(range(1, least(length(key), 6) + 1)) AS n FROM cat)) WHERE rank <= 5""",
    _CATALOGUE,
)
def prefix_index(spark, sf_dir):
    return prefix.prefix_index(_catalogue(spark, sf_dir)).select("prefix", "rank", "title", "popularity")


@query(
    """SELECT query, rank, title, popularity FROM (
    SELECT query, title, popularity, row_number() OVER (PARTITION BY query ORDER BY popularity DESC, key) AS rank
    FROM (SELECT DISTINCT '  ' || upper(substr(p_name, 1, 3)) || ' ' AS query FROM part) JOIN cat ON starts_with(key, lower(trim(query)))) WHERE rank <= 8""",
    _CATALOGUE,
)
def suggestions(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.concat(F.lit("  "), F.upper(F.substring("p_name", 1, 3)), F.lit(" ")).alias("query"))
    return prefix.suggestions(asked, _catalogue(spark, sf_dir))


@query("SELECT word, popularity FROM (VALUES ('RED PLATE'), ('red plate'), ('no such part')) t(word) LEFT JOIN cat ON key = lower(word)", _CATALOGUE)
def title_search(spark, sf_dir):
    words = spark.createDataFrame([("RED PLATE",), ("red plate",), ("no such part",)], "word string")
    return prefix.lookup(words, _catalogue(spark, sf_dir)).select("word", "popularity")


@query("SELECT prefix, prefix = '' OR EXISTS (SELECT 1 FROM cat WHERE starts_with(key, lower(prefix))) AS found FROM (VALUES " + ", ".join(f"('{p}')" for p in PREFIXES) + ") t(prefix)", _CATALOGUE)
def starts_with(spark, sf_dir):
    return prefix.any_with_prefix(_catalogue(spark, sf_dir), PREFIXES)


@query("SELECT key, popularity, false AS gone FROM cat WHERE key <> 'red plate' UNION ALL SELECT 'Red Plate', NULL, true UNION ALL SELECT 'no such part', NULL, false", _CATALOGUE)
def title_delete(spark, sf_dir):
    """The catalogue after a deletion, and which of the words it had."""
    words = spark.createDataFrame([("Red Plate",), ("no such part",)], "word string")
    left, told = prefix.deleted(_catalogue(spark, sf_dir), words)
    told = told.select(F.col("word").alias("key"), F.lit(None).cast("long").alias("popularity"), F.col("existed").alias("gone"))
    return left.select("key", "popularity", F.lit(False).alias("gone")).unionByName(told)


# -- sketches ---------------------------------------------------------------------------------


def _slot(prefix_: str, item: str, width: int) -> str:
    return f"CAST(('0x' || substr(sha256({prefix_} || ':' || {item}), 1, 16))::UBIGINT % {width} AS INTEGER)"


_ROWS = "(VALUES " + ", ".join(f"({r}, '{row_seed(r)}')" for r in range(DEPTH)) + ") r(row, seed)"
_CELLS = f"""{EVENTS}, exact AS (SELECT item, count(*) AS n FROM ev GROUP BY item),
  slots AS (SELECT item, n, row, {_slot("seed", "item", WIDTH)} AS col FROM exact, {_ROWS}),
  cells AS (SELECT row, col, CAST(sum(n) AS BIGINT) AS n FROM slots GROUP BY row, col),
  estimates AS (SELECT s.item, min(c.n) AS estimate FROM slots s JOIN cells c USING (row, col) GROUP BY s.item)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.cms_cells(_events(spark, sf_dir), "item", WIDTH, DEPTH)


@query("SELECT row, col, n FROM cells", _CELLS)
def cms_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


@query("SELECT row, col, n FROM cells", _CELLS)
def cms_merge(spark, sf_dir):
    """Sketches of parts, added up, are the sketch of all."""
    events = _events(spark, sf_dir)
    parts = [events.filter(F.col("event_type") == "view"), events.filter(F.col("event_type") != "view")]
    return sketches.cms_merged(*[sketches.cms_cells(p, "item", WIDTH, DEPTH) for p in parts])


@query("SELECT item, estimate FROM estimates UNION ALL SELECT -1, 0", _CELLS)
def cms_estimates(spark, sf_dir):
    asked = _events(spark, sf_dir).select("item").union(spark.createDataFrame([(-1,)], "item int"))
    return sketches.cms_estimates(asked, _cells(spark, sf_dir), "item", WIDTH, DEPTH).filter("item >= 0 or estimate = 0")


@query("SELECT round(avg(abs(estimate - n)), 6) AS mean_absolute, round(avg((estimate - n) / n), 6) AS mean_relative FROM estimates JOIN exact USING (item)", _CELLS)
def cms_errors(spark, sf_dir):
    events = _events(spark, sf_dir)
    exact = events.groupBy("item").agg(F.count("*").alias("n"))
    return sketches.cms_errors(sketches.cms_estimates(events, _cells(spark, sf_dir), "item", WIDTH, DEPTH), exact, "item")


_WIDE = ", ".join(f"({r}, '{17 + 131 * r}')" for r in range(7))


@query(f"SELECT row, {_slot('seed', 'item', 5000)} AS col, CAST(sum(n) AS BIGINT) AS n FROM exact, (VALUES {_WIDE}) w(row, seed) GROUP BY ALL", _CELLS)
def cms_wide(spark, sf_dir):
    """The second sketch: 5,000 by 7 cells, with seeds of its own."""
    return sketches.cms_cells(_events(spark, sf_dir), "item", 5000, 7, seeds=[17 + 131 * r for r in range(7)])


@query(f"SELECT hour, row, {_slot('seed', 'item', WIDTH)} AS col, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS hour, item FROM ev), {_ROWS} GROUP BY ALL")
def cms_by_hour(spark, sf_dir):
    """A sketch that starts anew each hour."""
    events = _events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return sketches.cms_cells(events, "item", WIDTH, DEPTH, by=["hour"])


@query(f"SELECT {WIDTH} AS width, {DEPTH} AS depth, {WIDTH * DEPTH} AS cells, count(*) AS updates, count(DISTINCT item) AS items, round(exp(1) / {WIDTH}, 9) AS epsilon, round(exp(-{DEPTH}), 9) AS delta FROM ev")
def cms_stats(spark, sf_dir):
    return sketches.cms_stats(_events(spark, sf_dir), "item", WIDTH, DEPTH)


_ERROR = 0.01
_BLOOM = f"""hashes AS (SELECT unnest(range({HASHES})) AS i),
  size AS (SELECT CAST(ceil(-count(*) * ln({_ERROR}) / pow(ln(2), 2)) AS BIGINT) AS m FROM customer),
  bits AS (SELECT DISTINCT {_slot("i", "c_custkey", "(SELECT m FROM size)::UBIGINT")} AS bit FROM customer, hashes),
  asked AS (SELECT c_custkey FROM customer UNION ALL SELECT -1 - c_custkey FROM customer)"""


def _filter(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int, int]:
    """The bits of a filter of all customers, made for their number; its capacity, bits and hash functions."""
    customers = table(spark, sf_dir, "customer")
    capacity = customers.count()
    bits, hashes = bloom_size(capacity, _ERROR)
    return sketches.bloom_bits(customers, "c_custkey", bits, hashes), capacity, bits, hashes


def _strangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many ids as there are customers, none of which is one."""
    return table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("c_custkey"))


@query("SELECT bit FROM bits", _BLOOM)
def bloom_bits(spark, sf_dir):
    return _filter(spark, sf_dir)[0]


@query("SELECT count(*) AS bits FROM bits", _BLOOM)
def bloom_packed(spark, sf_dir):
    return sketches.bloom_packed(_filter(spark, sf_dir)[0]).agg(F.sum(F.bitmap_count("bitmap")).alias("bits"))


@query(f"SELECT c_custkey, count(b.bit) = {HASHES} AS contained FROM asked CROSS JOIN hashes LEFT JOIN bits b ON b.bit = {_slot('i', 'c_custkey', '(SELECT m FROM size)::UBIGINT')} GROUP BY c_custkey", _BLOOM)
def bloom_contains(spark, sf_dir):
    """All customers are contained, and some strangers."""
    found, _, bits, hashes = _filter(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select("c_custkey").union(_strangers(spark, sf_dir))
    return sketches.bloom_contains(asked, found, "c_custkey", bits, hashes)


@query(
    f"""SELECT round(avg(CASE WHEN contained THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (
    SELECT c_custkey, count(b.bit) = {HASHES} AS contained FROM asked CROSS JOIN hashes LEFT JOIN bits b ON b.bit = {_slot("i", "c_custkey", "(SELECT m FROM size)::UBIGINT")}
    WHERE c_custkey < 0 GROUP BY c_custkey)""",
    _BLOOM,
)
def bloom_false_positives(spark, sf_dir):
    found, _, bits, hashes = _filter(spark, sf_dir)
    flags = sketches.bloom_contains(_strangers(spark, sf_dir), found, "c_custkey", bits, hashes)
    return flags.agg(F.round(F.avg(F.col("contained").cast("double")), 6).alias("rate"))


@query(
    f"""SELECT m AS bits, {HASHES} AS hashes, (m + 7) // 8 AS bytes, (SELECT count(*) FROM customer) AS adds,
    round((SELECT count(*) FROM bits) / m, 6) AS fill,
    round(pow(1 - exp(-{HASHES}.0 * (SELECT count(*) FROM customer) / m), {HASHES}), 6) AS false_positive_rate FROM size""",
    _BLOOM,
)
def bloom_info(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return sketches.bloom_info(customers, "c_custkey", customers.count(), _ERROR)


_DUP_BITS, _DUP_HASHES = 20_000, 4
_TOKENS = f"""{EVENTS}, tok AS (SELECT seq, event_id, CAST(user_id AS VARCHAR) || ':' || item || ':' || CAST(floor(epoch(ts) / {DAY}) AS BIGINT) AS token FROM ev)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequence(spark, sf_dir).select("seq", "event_id", running.dedup_key(F.col("user_id"), F.col("item"), F.col("ts"), DAY).alias("token"))


@query(
    f""", t AS (SELECT seq, event_id, {_slot("i", "token", _DUP_BITS)} AS bit FROM tok, (SELECT unnest(range({_DUP_HASHES})) AS i)),
    f AS (SELECT bit, min(seq) AS first FROM t GROUP BY bit)
    SELECT event_id, max(first) < min(seq) AS duplicate FROM t JOIN f USING (bit) GROUP BY event_id""",
    _TOKENS,
)
def bloom_flags(spark, sf_dir):
    """A filter so small that it has false positives, which both sides must give."""
    return sketches.bloom_flags(_tokens(spark, sf_dir), "token", _DUP_BITS, _DUP_HASHES).select("event_id", "duplicate")


@query(
    f""", t AS (SELECT seq, event_id, {_slot("i", "token", 200_000)} AS bit FROM tok, (SELECT unnest(range(7)) AS i)),
    f AS (SELECT bit, min(seq) AS first FROM t GROUP BY bit)
    SELECT event_id, max(first) < min(seq) AS duplicate FROM t JOIN f USING (bit) GROUP BY event_id""",
    _TOKENS,
)
def bloom_flags_wide(spark, sf_dir):
    """The second filter: 200,000 bits and 7 hash functions."""
    return sketches.bloom_flags(_tokens(spark, sf_dir), "token", 200_000, 7).select("event_id", "duplicate")


@query("SELECT event_id, row_number() OVER (PARTITION BY token ORDER BY seq) > 1 AS duplicate FROM tok", _TOKENS)
def exact_flags(spark, sf_dir):
    return sketches.exact_flags(_tokens(spark, sf_dir), "token").select("event_id", "duplicate")


@query("SELECT event_type FROM events GROUP BY event_type HAVING count(*) > (SELECT count(*) FROM events) / 8", ctes="")
def misra_gries_survivors(spark, sf_dir):
    """Items above N / 8 always survive; exact counts then drop the others."""
    return _heavy(table(spark, sf_dir, "events"), "event_type", 8)


@query("SELECT item FROM ev GROUP BY item HAVING count(*) > (SELECT count(*) FROM ev) / 110")
def misra_gries_heavy(spark, sf_dir):
    return _heavy(_events(spark, sf_dir), "item", 110)


def _heavy(events: DataFrame, item: str, k: int) -> DataFrame:
    """Items above N / k, counted exactly among those that a summary of k counters has kept."""
    found = sketches.misra_gries(events, item, k)
    counts = events.join(F.broadcast(found.select(item)), item, "left_semi").groupBy(item).agg(F.count("*").alias("n"))  # k rows at most
    total = events.agg(F.count("*").alias("all"))
    return counts.crossJoin(F.broadcast(total)).filter(f"n > all / {k}").select(item)  # one row


@query()
def misra_gries(spark, sf_dir):
    return sketches.misra_gries(_sequence(spark, sf_dir), "item", 80, seq="seq").orderBy(F.desc("n"), "item")


@query()
def misra_gries_precision(spark, sf_dir):
    """How many of the 20 most frequent items merged summaries of 80 counters rank among their 20."""
    events = _events(spark, sf_dir)
    approx = sketches.misra_gries(events, "item", 80).orderBy(F.desc("n"), "item").limit(20)
    return ranking.precision(ranking.top_k(events, "item", 20), approx, "item", 20)


# -- running counts ---------------------------------------------------------------------------


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS running FROM ev")
def running_user_count(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("order", F.struct("ts", "event_id"))
    return running.running_count(rows, "user_id", "order").select("event_id", "running")


@query(
    f""", s AS (SELECT seq, event_id, user_id, row, {_slot("seed", "user_id", 64)} AS col FROM ev, (VALUES {", ".join(f"({r}, '{row_seed(r)}')" for r in range(3))}) r(row, seed)),
    c AS (SELECT seq, event_id, min(n) AS estimate FROM (SELECT *, count(*) OVER (PARTITION BY row, col ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM s) GROUP BY seq, event_id)
    SELECT event_id, row_number() OVER (PARTITION BY token ORDER BY seq) > 1 AS duplicate,
      count(*) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS exact, estimate, estimate >= 40 AS anomalous
    FROM ev JOIN tok USING (seq, event_id) JOIN c USING (seq, event_id)""",
    _TOKENS,
)
def anomalies(spark, sf_dir):
    rows = _sequence(spark, sf_dir).withColumn("token", running.dedup_key(F.col("user_id"), F.col("item"), F.col("ts"), DAY))
    found = running.anomalies(rows, "token", "user_id", 64, 3, 40)
    return found.join(rows.select("seq", "event_id"), "seq").select("event_id", "duplicate", "exact", "estimate", "anomalous")


@query("SELECT event_id, lower(trim('  ' || upper(event_type) || ':' || user_id || ' ')) AS token, trim(' 10.0.' || user_id || ' ') AS source FROM events", ctes="")
def normalised_tokens(spark, sf_dir):
    """Tokens without white space at their ends, in small letters; addresses without white space."""
    raw = F.concat(F.lit("  "), F.upper("event_type"), F.lit(":"), F.col("user_id").cast("string"), F.lit(" "))
    source = F.concat(F.lit(" 10.0."), F.col("user_id").cast("string"), F.lit(" "))
    return table(spark, sf_dir, "events").select("event_id", running.normalised_token(raw).alias("token"), running.normalised_source(source).alias("source"))


@query("SELECT item, rank, round(sum(1.0 / rank) OVER (ORDER BY rank) / sum(1.0 / rank) OVER (), 9) AS cumulative FROM (SELECT item, row_number() OVER (ORDER BY n DESC, item) AS rank FROM exact)", _CELLS)
def cumulative_weights(spark, sf_dir):
    """Zipf's weights of the items in the order of their counts, summed up."""
    counts = _events(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"))
    ranked = ranking.numbered(counts, -F.col("n"), [F.desc("n"), F.col("item")], "rank").withColumn("weight", 1 / F.col("rank").cast("double"))
    return running.cumulative_weights(ranked, "rank", "weight").select("item", "rank", F.round("cumulative", 9).alias("cumulative"))


# -- caches -----------------------------------------------------------------------------------

_TRACE = f"""{EVENTS}, v AS (SELECT seq, event_id, item, lag(seq) OVER (PARTITION BY item ORDER BY seq) AS prev FROM ev WHERE event_type = 'view'),
  d AS (SELECT seq, event_id, item, prev, (SELECT count(DISTINCT o.item) FROM v o WHERE o.seq > v.prev AND o.seq < v.seq) AS distance FROM v),
  h AS (SELECT seq, event_id, item, prev IS NOT NULL AND distance < {CACHE} AS hit FROM d)"""


@query(f"SELECT item, max(seq) AS last_seq FROM ev WHERE event_type = 'view' GROUP BY item ORDER BY last_seq DESC LIMIT {CACHE}")
def lru_residents(spark, sf_dir):
    return cache.residents(_views(spark, sf_dir), CACHE)


@query("SELECT item, max(seq) AS last_seq FROM ev WHERE event_type = 'view' GROUP BY item ORDER BY last_seq DESC LIMIT 10")
def lru_most_recent(spark, sf_dir):
    return cache.most_recent(_views(spark, sf_dir), 10)


@query("SELECT seq, item, hit FROM h", _TRACE)
def lru_hits(spark, sf_dir):
    return cache.hits(_views(spark, sf_dir), CACHE)


@query("SELECT seq, item, hit FROM h", _TRACE)
def lru_replay(spark, sf_dir):
    return cache.replay(_views(spark, sf_dir), CACHE).select("seq", "item", "hit")


@query(
    f"""SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(100 * count(*) FILTER (hit) / count(*), 2) AS hit_rate,
    count(*) FILTER (NOT hit) - least({CACHE}, count(DISTINCT item)) AS evictions, count(*) AS requests,
    least({CACHE}, count(DISTINCT item)) AS size, {CACHE} AS capacity, round(100 * least({CACHE}, count(DISTINCT item)) / {CACHE}, 2) AS fill FROM h""",
    _TRACE,
)
def lru_stats(spark, sf_dir):
    return cache.stats(cache.replay(_views(spark, sf_dir), CACHE), CACHE)


@query("SELECT c AS capacity, count(*) FILTER (prev IS NOT NULL AND distance < c) AS hits, count(*) AS requests, round(100 * count(*) FILTER (prev IS NOT NULL AND distance < c) / count(*), 2) AS hit_rate FROM d, (SELECT unnest(" + str(CAPACITIES) + ") AS c) GROUP BY c", _TRACE)
def lru_hit_curve(spark, sf_dir):
    return cache.curve(_views(spark, sf_dir), CAPACITIES)


@query("SELECT n, rate FROM (SELECT row_number() OVER (ORDER BY seq) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS rate FROM h) WHERE n % 100 = 0", _TRACE)
def cumulative_hit_rate(spark, sf_dir):
    return running.cumulative_rate(cache.replay(_views(spark, sf_dir), CACHE))


@query(
    """, w AS (SELECT seq, user_id % 4 AS shard, item, lag(seq) OVER (PARTITION BY user_id % 4, item ORDER BY seq) AS prev FROM ev WHERE event_type = 'view')
    SELECT seq, shard, item, prev IS NOT NULL AND (SELECT count(DISTINCT o.item) FROM w o WHERE o.shard = w.shard AND o.seq > w.prev AND o.seq < w.seq) < 10 AS hit FROM w"""
)
def lru_replay_sharded(spark, sf_dir):
    rows = _views(spark, sf_dir).withColumn("shard", F.col("user_id") % 4)
    return cache.replay(rows, 10, shard=["shard"]).select("seq", "shard", "item", "hit")


# -- similarity -------------------------------------------------------------------------------

_SETS = f"""{EVENTS}, m AS (SELECT DISTINCT item, user_id AS member FROM ev WHERE item IS NOT NULL AND user_id IS NOT NULL),
  z AS (SELECT item, count(*) AS n FROM m GROUP BY item)"""


def _signature_ctes(sets: str, hashes: int, bands: int, item: str = "item", member: str = "member") -> str:
    b, r = bands_and_rows(hashes, bands)
    values = ", ".join(f"({i}, {a}, {c})" for i, (a, c) in enumerate(minhash_parameters(hashes)))
    return f"""p(i, a, b) AS (VALUES {values}),
  x AS (SELECT {item} AS item, CAST(('0x' || substr(sha256(CAST({member} AS VARCHAR)), 1, 8))::UBIGINT AS HUGEINT) AS x FROM {sets}),
  g AS (SELECT item, i, CAST(min((a::HUGEINT * x + b) % {PRIME}) AS BIGINT) AS h FROM x, p GROUP BY item, i),
  sig AS (SELECT item, list(h ORDER BY i) AS signature FROM g GROUP BY item),
  bk AS (SELECT item, k AS band, signature[k * {r} + 1 : k * {r} + {r}] AS bucket FROM sig, (SELECT unnest(range({b})) AS k)),
  cand AS (SELECT DISTINCT l.item AS a, r.item AS b FROM bk l JOIN bk r USING (band, bucket) WHERE l.item < r.item),
  sim AS (SELECT a, b, len([1 FOR q IN list_zip(l.signature, r.signature) IF q[1] = q[2]]) / {hashes}.0 AS s
    FROM cand JOIN sig l ON l.item = a JOIN sig r ON r.item = b)"""


_LSH = _SETS + ", " + _signature_ctes("m", 100, 20)


@query("SELECT a.item AS a, b.item AS b, count(*) AS \"both\", round(count(*) / (any_value(za.n) + any_value(zb.n) - count(*)), 9) AS jaccard FROM m a JOIN m b ON a.member = b.member AND a.item < b.item JOIN z za ON za.item = a.item JOIN z zb ON zb.item = b.item GROUP BY a.item, b.item", _SETS)
def jaccard_pairs(spark, sf_dir):
    return similarity.jaccard_pairs(_sets(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9))


@query("SELECT item, signature FROM sig", _LSH)
def minhash_signatures(spark, sf_dir):
    return similarity.signatures(_sets(spark, sf_dir))


@query("SELECT item, CAST(band AS INTEGER) AS band, bucket FROM bk", _LSH)
def lsh_buckets(spark, sf_dir):
    return similarity.buckets(similarity.signatures(_sets(spark, sf_dir)), 100, 20)


@query("SELECT a, b FROM cand", _LSH)
def lsh_candidates(spark, sf_dir):
    return similarity.candidates(similarity.signatures(_sets(spark, sf_dir)))


@query("SELECT a, b, round(s, 4) AS similarity FROM sim WHERE s >= 0.3", _LSH)
def lsh_similar(spark, sf_dir):
    return similarity.similar(similarity.signatures(_sets(spark, sf_dir)), threshold=0.3)


@query("SELECT (SELECT count(*) FROM sig) AS items, 100 AS hashes, 20 AS bands, 5 AS rows, count(*) AS buckets FROM (SELECT DISTINCT band, bucket FROM bk)", _LSH)
def lsh_stats(spark, sf_dir):
    return similarity.lsh_stats(similarity.signatures(_sets(spark, sf_dir)))


@query(
    """, two AS (SELECT a AS item, b AS other, round(s, 4) AS similarity FROM sim WHERE s >= 0.1 UNION ALL SELECT b, a, round(s, 4) FROM sim WHERE s >= 0.1)
    SELECT item, rank, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, other) AS rank FROM two) WHERE rank <= 10""",
    _LSH,
)
def recommendations(spark, sf_dir):
    return similarity.recommended(similarity.signatures(_sets(spark, sf_dir)))


_USERS = f"""{EVENTS}, m AS (SELECT DISTINCT user_id AS item, item AS member FROM ev WHERE item IS NOT NULL AND user_id IS NOT NULL),
  z AS (SELECT item, count(*) AS n FROM m GROUP BY item),
  q AS (SELECT item FROM z),
  o AS (SELECT a.item, b.item AS other, count(*) AS n FROM m a JOIN m b ON a.member = b.member AND a.item <> b.item WHERE a.item IN (SELECT item FROM q) GROUP BY a.item, b.item),
  top AS (SELECT * FROM (SELECT q.item, z.item AS other, round(coalesce(o.n, 0) / (zq.n + z.n - coalesce(o.n, 0)), 9) AS jaccard,
      row_number() OVER (PARTITION BY q.item ORDER BY coalesce(o.n, 0) / (zq.n + z.n - coalesce(o.n, 0)) DESC, z.item DESC) AS rank
    FROM q JOIN z ON z.item <> q.item JOIN z zq ON zq.item = q.item LEFT JOIN o ON o.item = q.item AND o.other = z.item) WHERE rank <= 5)"""
_APPROX = (
    _USERS
    + ", "
    + _signature_ctes("m", 64, 32)
    + """, pairs AS (SELECT a AS item, b AS other FROM cand UNION SELECT b, a FROM cand),
  near AS (SELECT * FROM (SELECT c.item, c.other, round(coalesce(o.n, 0) / (zq.n + z.n - coalesce(o.n, 0)), 9) AS jaccard,
      row_number() OVER (PARTITION BY c.item ORDER BY coalesce(o.n, 0) / (zq.n + z.n - coalesce(o.n, 0)) DESC, c.other DESC) AS rank
    FROM pairs c JOIN q USING (item) JOIN z ON z.item = c.other JOIN z zq ON zq.item = c.item LEFT JOIN o ON o.item = c.item AND o.other = c.other) WHERE rank <= 5)"""
)


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item) of all events, as they come."""
    return _events(spark, sf_dir).select(F.col("user_id").alias("item"), F.col("item").alias("member"))


@query("SELECT item, rank, other, jaccard FROM top", _USERS)
def top_exact_users(spark, sf_dir):
    return similarity.top_exact(_watched(spark, sf_dir)).select("item", "rank", "other", F.round("jaccard", 9).alias("jaccard"))


@query("SELECT item, rank, other, jaccard FROM near", _APPROX)
def top_approximate_users(spark, sf_dir):
    found = similarity.top_approximate(_watched(spark, sf_dir))
    return found.select("item", "rank", "other", F.round("jaccard", 9).alias("jaccard"))


@query("SELECT top.item, count(near.other) AS hits, round(count(near.other) / 5, 6) AS precision FROM top LEFT JOIN near ON near.item = top.item AND near.other = top.other GROUP BY top.item", _APPROX)
def precision_at_k(spark, sf_dir):
    return similarity.precision_of_searches(_watched(spark, sf_dir))


@query("SELECT item, member FROM m WHERE NOT (item = 1 AND member % 2 = 0) UNION SELECT 1, user_id FROM ev WHERE item = 2", _SETS)
def audience_swap(spark, sf_dir):
    """Item 1 loses every other member, and gains those of item 2."""
    sets = _sets(spark, sf_dir)
    out = sets.filter("item = 1 and member % 2 = 0")
    return similarity.swapped(sets, out, sets.filter("item = 2").withColumn("item", F.lit(1)))


@query("SELECT member FROM m WHERE item = 1 INTERSECT SELECT member FROM m WHERE item = 2", _SETS)
def audience_intersection(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    return sets.filter("item = 1").select("member").intersect(sets.filter("item = 2").select("member"))


# -- the play pipeline ------------------------------------------------------------------------

_PLAYS = f"""{_TOKENS}, f AS (SELECT seq, event_id, user_id, item, row_number() OVER (PARTITION BY token ORDER BY seq) > 1 AS dup,
    item IN (SELECT p_partkey FROM part) AS known FROM ev JOIN tok USING (seq, event_id) WHERE event_type = 'view'),
  s AS (SELECT seq, item, lag(seq) OVER (PARTITION BY item ORDER BY seq) AS prev FROM f WHERE NOT dup AND known),
  h AS (SELECT seq, prev IS NOT NULL AND (SELECT count(DISTINCT o.item) FROM s o WHERE o.seq > s.prev AND o.seq < s.seq) < {CACHE} AS hit FROM s),
  plays AS (SELECT f.*, CASE WHEN dup THEN 'duplicate' WHEN NOT known THEN 'unknown' WHEN hit THEN 'hit' ELSE 'miss' END AS outcome FROM f LEFT JOIN h USING (seq))"""


def _served(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return pipeline.outcomes(_sequence(spark, sf_dir), _items(spark, sf_dir), pipeline.Settings(cache_capacity=CACHE, bucket=DAY, **options))


@query("SELECT event_id, item, outcome FROM plays", _PLAYS)
def play_outcomes(spark, sf_dir):
    return _served(spark, sf_dir).select("event_id", "item", "outcome")


@query("SELECT event_id, item, outcome FROM plays", _PLAYS)
def play_outcomes_bloom(spark, sf_dir):
    """As play_outcomes, by a filter large enough to have no false positive here."""
    return _served(spark, sf_dir, exact=False, bloom_capacity=2_000_000, bloom_error=1e-9).select("event_id", "item", "outcome")


@query("SELECT item, coalesce((SELECT min(p_name) FROM part WHERE p_partkey = item), CAST(item AS VARCHAR)) AS title, count(*) AS plays FROM plays WHERE outcome IN ('hit', 'miss') GROUP BY item ORDER BY plays DESC, item LIMIT 10", _PLAYS)
def trending(spark, sf_dir):
    return pipeline.trending(_served(spark, sf_dir), _items(spark, sf_dir))


@query(
    """SELECT (SELECT count(*) FROM events) AS queued, count(*) FILTER (outcome IN ('hit', 'miss')) AS plays, count(*) FILTER (dup) AS duplicates,
    count(*) FILTER (outcome = 'unknown') AS unknown, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses,
    count(DISTINCT user_id) FILTER (outcome IN ('hit', 'miss')) AS active_users, count(DISTINCT item) FILTER (outcome IN ('hit', 'miss')) AS items,
    round(100 * count(*) FILTER (outcome = 'hit') / count(*) FILTER (NOT dup), 2) AS hit_rate, 0 AS searches FROM plays""",
    _PLAYS,
)
def pipeline_totals(spark, sf_dir):
    return pipeline.totals(_events(spark, sf_dir), _served(spark, sf_dir))


@query(
    """, aud AS (SELECT DISTINCT item, user_id AS member FROM plays WHERE outcome IN ('hit', 'miss')), """
    + _signature_ctes("aud", 100, 20)
    + """, big AS (SELECT item FROM aud GROUP BY item HAVING count(*) >= 5),
    two AS (SELECT a AS item, b AS other, round(s, 4) AS similarity FROM sim WHERE s >= 0.1 UNION ALL SELECT b, a, round(s, 4) FROM sim WHERE s >= 0.1)
    SELECT item, rank, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, other) AS rank
      FROM two WHERE other IN (SELECT item FROM big)) WHERE rank <= 10""",
    _PLAYS,
)
def play_recommendations(spark, sf_dir):
    return pipeline.recommendations(_served(spark, sf_dir), SETTINGS)


# -- streams and sources ----------------------------------------------------------------------


@query("SELECT event_type, hour, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) AS hour FROM ev) GROUP BY ALL")
def stream_hourly_counts(spark, sf_dir):
    return streams.finished(streams.hourly_counts(streams.source(spark, sf_dir))).select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "n")


@query(f"SELECT count(*) AS events FROM (SELECT DISTINCT user_id, item, floor(epoch(ts) / {DAY}) FROM ev)")
def stream_deduplicated(spark, sf_dir):
    return streams.finished(streams.deduplicated(streams.source(spark, sf_dir), DAY, "60 days")).agg(F.count("*").alias("events"))


@query("SELECT seq, item, hit FROM h", _TRACE)
def stream_cache(spark, sf_dir):
    """A cache fed by a stream: each micro-batch goes on from the state that the last one left."""
    return streams.cache_hits(_views(spark, sf_dir), CACHE)


@query()
def generated_users(spark, sf_dir):
    return generators.users(spark, 2000)


@query()
def generated_events(spark, sf_dir):
    return generators.events(spark, generators.users(spark, 300), generators.videos(spark, 100), 5000)


@query()
def generated_cowatch(spark, sf_dir):
    return generators.cowatch(generators.users(spark, 300), generators.videos(spark, 100))


@query()
def generated_videos(spark, sf_dir):
    return generators.videos(spark, 500)


@query()
def generated_stream_events(spark, sf_dir):
    return generators.stream_events(spark, 5000)


@query()
def generated_accesses(spark, sf_dir):
    return generators.access_stream(spark, 5000, 1000)


@query()
def generated_duplicates(spark, sf_dir):
    return generators.duplicate_events(spark, 5000)


@query()
def generated_histories(spark, sf_dir):
    return generators.watch_histories(spark)


@query()
def generated_titles_and_prefixes(spark, sf_dir):
    """Suggestions for generated beginnings of generated titles."""
    titles = generators.catalogue_titles(spark, 600)
    found = prefix.catalogue(titles.select("title", F.lit(1).alias("popularity"), F.lit(0).alias("seq")))
    return prefix.suggestions(generators.prefix_queries(titles, 300), found, 3)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer", ctes="")
def json_sink(spark, sf_dir):
    """A table written as JSON lines, and read again."""
    path = scratch.fresh_path(spark, "customer")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    scratch.write_json(rows, path)
    return scratch.read_json(spark, path, "c_custkey bigint, c_name string, c_nationkey int")


@query(
    """, e AS (SELECT row_number() OVER (ORDER BY n DESC, item) AS rank, item, n FROM exact QUALIFY rank <= 10),
    a AS (SELECT row_number() OVER (ORDER BY estimate DESC, item) AS rank, item, estimate FROM estimates QUALIFY rank <= 10)
    SELECT CAST(rank AS INTEGER) AS rank, e.item AS exact, e.n AS exact_n, a.item AS approx, a.estimate AS approx_n FROM e FULL JOIN a USING (rank)""",
    _CELLS,
)
def ranks_side_by_side(spark, sf_dir):
    """The ten most frequent items by exact counts, and by Count-Min estimates."""
    events = _events(spark, sf_dir)
    estimates = sketches.cms_estimates(events, _cells(spark, sf_dir), "item", WIDTH, DEPTH).withColumnRenamed("estimate", "n")
    return similarity.ranked_together(ranking.top_k(events, "item", 10), estimates.orderBy(F.desc("n"), "item").limit(10), "item")


@query("SELECT 'hits' AS name, CAST(count(*) FILTER (hit) AS DOUBLE) AS value FROM h UNION ALL SELECT 'misses', count(*) FILTER (NOT hit) FROM h UNION ALL SELECT 'hit_rate', round(100 * count(*) FILTER (hit) / count(*), 2) FROM h", _TRACE)
def cache_report(spark, sf_dir):
    """Statistics as rows of a name and a value."""
    row = cache.stats(cache.replay(_views(spark, sf_dir), CACHE), CACHE)
    names = ["hits", "misses", "hit_rate"]
    return row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "name", "value")


@query("SELECT round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM h", _TRACE)
def cache_fraction(spark, sf_dir):
    """The hit rate as a fraction of 1."""
    row = cache.stats(cache.replay(_views(spark, sf_dir), CACHE), CACHE)
    return row.select(F.round(F.col("hits") / F.col("requests"), 6).alias("hit_rate"))


@query(
    f""", ops AS (SELECT seq, item, CASE WHEN seq % 3 = 0 THEN 'put' ELSE 'contains' END AS op FROM ev WHERE item IS NOT NULL),
    p AS (SELECT seq, item, lag(seq) OVER (PARTITION BY item ORDER BY seq) AS prev FROM ops WHERE op = 'put'),
    gone AS (SELECT p.item, p.seq AS put, lead(p.seq) OVER (PARTITION BY p.item ORDER BY p.seq) AS again FROM p)
    SELECT o.seq, o.op, o.item, coalesce(g.put IS NOT NULL AND (SELECT count(DISTINCT x.item) FROM p x WHERE x.seq > g.put AND x.seq < o.seq) < {CACHE}, false) AS answer
    FROM ops o LEFT JOIN gone g ON g.item = o.item AND g.put < o.seq AND (g.again IS NULL OR g.again >= o.seq)"""
)
def cache_operations(spark, sf_dir):
    """Puts, and looks that don't refresh: whether the item was there."""
    trace = _sequence(spark, sf_dir).filter("item is not null").select("seq", F.when(F.col("seq") % 3 == 0, "put").otherwise("contains").alias("op"), "item")
    return cache.operated(trace, CACHE).select("seq", "op", "item", "answer")


@query(
    f""", c AS (SELECT lower(p_name) AS key, sum(p_size) AS popularity FROM part GROUP BY 1)
    SELECT 'cache' AS section, 'hits' AS name, CAST(count(*) FILTER (hit) AS DOUBLE) AS value FROM h UNION ALL SELECT 'cache', 'misses', count(*) FILTER (NOT hit) FROM h
    UNION ALL SELECT 'cache', 'capacity', {CACHE} UNION ALL SELECT 'cache', 'size', least({CACHE}, count(DISTINCT item)) FROM h
    UNION ALL SELECT 'sketch', 'updates', count(*) FROM ev UNION ALL SELECT 'sketch', 'items', count(DISTINCT item) FROM ev UNION ALL SELECT 'sketch', 'cells', {WIDTH * DEPTH}
    UNION ALL SELECT 'filter', 'adds', count(DISTINCT user_id) FROM ev UNION ALL SELECT 'filter', 'bits', {BITS} UNION ALL SELECT 'filter', 'hashes', {HASHES}
    UNION ALL SELECT 'prefixes', 'titles', count(*) FROM c UNION ALL SELECT 'prefixes', 'popularity', sum(popularity) FROM c
    UNION ALL SELECT 'similarity', 'items', count(DISTINCT item) FROM ev WHERE item IS NOT NULL AND user_id IS NOT NULL UNION ALL SELECT 'similarity', 'hashes', 100 UNION ALL SELECT 'similarity', 'bands', 20""",
    _TRACE,
)
def platform_report(spark, sf_dir):
    """Statistics of every part of the platform, as rows of a section, a name and a value."""
    events = _events(spark, sf_dir)
    played = cache.stats(cache.replay(_views(spark, sf_dir), CACHE), CACHE)
    filled = sketches.bloom_info(events.select("user_id").distinct(), "user_id", 1000, _ERROR)
    titles = _catalogue(spark, sf_dir).agg(F.count("*").alias("titles"), F.sum("popularity").alias("popularity"))
    signed = similarity.lsh_stats(similarity.signatures(_sets(spark, sf_dir)))
    return pipeline.report(
        {
            "cache": played.select("hits", "misses", "capacity", "size"),
            "sketch": sketches.cms_stats(events, "item", WIDTH, DEPTH).select("updates", "items", "cells"),
            "filter": filled.select("adds", "bits", "hashes"),
            "prefixes": titles,
            "similarity": signed.select("items", "hashes", "bands"),
        }
    )


@query("SELECT p_name, count(*) AS parts FROM part GROUP BY p_name EXCEPT SELECT p_name, count(*) FROM part WHERE p_size > 25 GROUP BY p_name", ctes="")
def catalogue_difference(spark, sf_dir):
    """Set difference of two counted catalogues."""
    parts = table(spark, sf_dir, "part")
    counted = lambda df: df.groupBy("p_name").agg(F.count("*").alias("parts"))
    return counted(parts).subtract(counted(parts.filter("p_size > 25")))


@query("SELECT CAST(p_partkey AS INTEGER) AS item FROM part EXCEPT SELECT item FROM exact", _CELLS)
def unplayed_items(spark, sf_dir):
    """Items of the catalogue that no event has."""
    return _items(spark, sf_dir).select("item").distinct().join(_events(spark, sf_dir).select("item"), "item", "left_anti")
