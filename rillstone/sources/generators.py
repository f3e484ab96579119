"""Synthetic tables, made on the executors from row numbers.

Every random number is a hash of (seed, what it is for, row number): the same rows come out
however many partitions make them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.ranking import graded_priority

# What generated rows may hold, and with which odds.
GENRES = ("Drama", "Comedia", "Acción", "Thriller", "Documental", "Anime", "Romance", "Sci-Fi", "Horror", "Crimen", "Aventura", "Fantasía", "Biográfico", "Musical", "Infantil")
COUNTRIES = ("USA", "España", "México", "Colombia", "Japón", "Corea del Sur", "Reino Unido", "Francia", "Alemania", "India")
LANGUAGES = ("Español", "Inglés", "Coreano", "Japonés", "Francés")
DEVICES = ("tv", "mobile", "tablet", "desktop")
METHODS = ("tarjeta", "paypal", "transferencia")
EVENT_WEIGHTS = {"stream": 70, "search": 10, "pause": 5, "resume": 5, "rating": 3, "payment": 2, "login": 2, "logout": 1, "browse": 1, "download": 1}
WITH_VIDEO = ("stream", "pause", "resume", "rating", "download")
STREAM_WEIGHTS = {"play": 0.34, "search": 0.2, "resume": 0.14, "download": 0.08, "payment": 0.06, "subscription": 0.03, "browse": 0.15}
ADJECTIVES = ("silent", "hidden", "electric", "golden", "red", "last", "broken", "wild", "cosmic", "urban", "midnight", "deep")
NOUNS = ("signal", "legend", "voyage", "empire", "code", "memory", "mirror", "archive", "shadow", "pulse", "network", "horizon")
SUFFIXES = ("origins", "chronicles", "protocol", "files", "effect", "session", "story")

#: Events are dated back from here, not from now, so that they can be made again.
BASE_TIME = 1_704_067_200


def uniform(seed: int, what: str, row: Column) -> Column:
    """A number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), row), 11).cast("double") / float(1 << 53)


def chosen(values: tuple | list, u: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int"))


def weighted(weights: dict[str, float], u: Column) -> Column:
    """A key with odds of its weight."""
    total, run, out = sum(weights.values()), 0.0, None
    for value, w in weights.items():
        run += w / total
        out = F.when(u < run, F.lit(value)) if out is None else out.when(u < run, F.lit(value))
    return out.otherwise(F.lit(next(reversed(weights))))


def sampled(values: tuple | list, n: Column, seed: int, what: str, row: Column) -> Column:
    """`n` distinct values, in the order of a hash of each."""
    keyed = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(what), row, F.lit(v)).alias("h"), F.lit(v).alias("v")) for v in values])
    return F.transform(F.slice(F.sort_array(keyed), F.lit(1), n), lambda x: x["v"])


def zipf(universe: int, skew: float, u: Column, v: Column) -> Column:
    """A rank from 1, with odds proportional to rank ** -skew, from two uniform numbers, by an alias table."""
    if universe <= 0:
        raise ValueError("universe is positive")
    weights = [(i + 1) ** -skew for i in range(universe)]
    scale = universe / sum(weights)
    odds, alias = [w * scale for w in weights], list(range(universe))
    small, large = [i for i, p in enumerate(odds) if p < 1], [i for i, p in enumerate(odds) if p >= 1]
    while small and large:
        s, x = small.pop(), large[-1]
        alias[s] = x
        odds[x] -= 1 - odds[s]
        if odds[x] < 1:
            small.append(large.pop())
    column = F.floor(u * universe).cast("int")
    keep = F.get(F.lit(odds), column) > v
    return F.when(keep, column).otherwise(F.get(F.lit(alias), column)).cast("long") + 1


def between(least: int, most: int, u: Column) -> Column:
    """A whole number from `least` to `most`."""
    return (least + F.floor(u * (most - least + 1))).cast("int")


def users(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    i, u = F.col("id"), lambda what: uniform(seed, what, F.col("id"))
    return spark.range(n).select(
        F.format_string("user_%04d", i).alias("user_id"),
        F.when(u("kind") < 0.35, "premium").otherwise("standard").alias("tipo"),
        between(16, 65, u("age")).alias("edad"),
        chosen(COUNTRIES, u("country")).alias("pais"),
        sampled(GENRES, between(2, 5, u("genres")), seed, "genre", i).alias("generos_favoritos"),
        F.make_date(F.lit(2023), between(1, 12, u("month")), between(1, 28, u("day"))).alias("fecha_registro"),
        (u("active") < 0.8).alias("activo"),
        F.transform(F.sequence(F.lit(1), between(1, 3, u("devices"))), lambda k: chosen(DEVICES, uniform(seed, "device", F.xxhash64(F.col("id"), k)))).alias("dispositivos"),
    )


def videos(spark: SparkSession, n: int = 500, seed: int = 123, titles: tuple | list = ()) -> DataFrame:
    """A catalogue; the first videos have the given titles, the others numbered ones."""
    i, u = F.col("id"), lambda what: uniform(seed, what, F.col("id"))
    series = u("kind") < 0.6
    views = F.least(F.floor(F.pow(1 - u("views"), F.lit(-1 / 1.5)) * 1e6), F.lit(150_000_000)).cast("long")
    numbered = F.concat(F.lit("Producción Original "), (i - len(titles)).cast("string"))
    named = F.get(F.array(*[F.lit(t) for t in titles]).cast("array<string>"), i.cast("int"))
    return spark.range(n).select(
        F.format_string("vid_%04d", i).alias("video_id"),
        F.coalesce(named, numbered).alias("titulo"),
        chosen(GENRES, u("genre")).alias("genero"),
        F.when(series, "serie").otherwise("pelicula").alias("tipo"),
        between(2015, 2024, u("year")).alias("anio"),
        chosen(COUNTRIES, u("country")).alias("pais_origen"),
        F.when(series, between(30, 60, u("length"))).otherwise(between(20, 180, u("length"))).alias("duracion_min"),
        F.when(series, between(1, 5, u("seasons"))).otherwise(1).cast("int").alias("temporadas"),
        F.round(5 + u("rating") * 4.5, 1).alias("calificacion_imdb"),
        views.alias("vistas_totales"),
        F.round(400 + u("size") * 1600, 1).alias("tamano_mb"),
        chosen(LANGUAGES, u("language")).alias("idioma_original"),
        sampled(GENRES, between(1, 3, u("tags")), seed, "tag", i).alias("tags"),
    )


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    """Keys with their rank; generated ids hold their number."""
    return rows.select(key, F.regexp_extract(key, r"(\d+)$", 1).cast("long").alias("_rank"))


def events(spark: SparkSession, user_rows: DataFrame, video_rows: DataFrame, n: int, skew: float = 0.8, seed: int = 456, asked_titles: int = 20) -> DataFrame:
    """Events over 30 days, by type weights, users drawn evenly, videos by Zipf's law over their rank.

    A search asks for the first word of one of the first titles; qualities, amounts and devices
    are those of the user.  Rows come in no fixed order.
    """
    many_users, many_videos = user_rows.count(), video_rows.count()
    i, u = F.col("id"), lambda what: uniform(seed, what, F.col("id"))
    kind = weighted(EVENT_WEIGHTS, u("kind"))
    rows = spark.range(n).select(
        i,
        F.format_string("evt_%06d", i).alias("evento_id"),
        F.floor(u("user") * many_users).alias("_u"),
        kind.alias("tipo"),
        F.when(kind.isin(*WITH_VIDEO), zipf(many_videos, skew, u("video"), u("alias")) - 1).when(kind == "search", F.floor(u("query") * min(asked_titles, many_videos))).alias("_v"),
        (F.lit(float(BASE_TIME)) - u("time") * 30 * 86400).alias("timestamp"),
    )
    user = user_rows.join(_ranked(user_rows, "user_id"), "user_id").select(F.col("_rank").alias("_u"), "user_id", F.col("tipo").alias("user_type"), "dispositivos")
    video = video_rows.join(_ranked(video_rows, "video_id"), "video_id").select(F.col("_rank").alias("_v"), F.col("video_id").alias("_id"), F.split("titulo", " ")[0].alias("_word"))
    out = rows.join(user, "_u").join(video, "_v", "left")
    premium, is_ = F.col("user_type") == "premium", lambda x: F.col("tipo") == x
    quality = F.when(premium, chosen(("SD", "HD", "4K"), u("quality"))).otherwise(chosen(("SD", "HD"), u("quality")))
    device = F.get("dispositivos", F.floor(u("device") * F.size("dispositivos")).cast("int"))
    details = (
        F.when(is_("stream"), F.create_map(F.lit("calidad"), quality, F.lit("dispositivo"), device, F.lit("duracion_vista"), between(1, 120, u("watched")).cast("string")))
        .when(is_("payment"), F.create_map(F.lit("monto"), F.when(premium, "15.99").otherwise("9.99"), F.lit("metodo"), chosen(METHODS, u("method"))))
        .when(is_("search"), F.create_map(F.lit("query"), F.col("_word")))
        .when(is_("rating"), F.create_map(F.lit("calificacion"), between(1, 5, u("stars")).cast("string")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    video_id = F.when(F.col("tipo").isin(*WITH_VIDEO), F.col("_id"))
    return out.select("evento_id", "user_id", "tipo", video_id.alias("video_id"), "timestamp", "user_type", details.alias("datos"))


def cowatch(user_rows: DataFrame, video_rows: DataFrame, seed: int = 7, least: int = 5, extra: int = 10) -> DataFrame:
    """Distinct (video_id, user_id): a share of each genre's fans that follows a video's views, and some users besides."""
    fans = user_rows.select("user_id", F.explode("generos_favoritos").alias("genero"))
    fan_counts = fans.groupBy("genero").agg(F.count("*").alias("_fans"))
    share = F.least(F.lit(0.9), F.col("vistas_totales") / 1e7)
    wanted = video_rows.join(fan_counts, "genero").select("video_id", "genero", F.greatest(F.lit(least) / F.col("_fans"), share).alias("_share"))
    pick = lambda what: uniform(seed, what, F.xxhash64("video_id", "user_id"))
    audience = wanted.join(fans, "genero").filter(pick("fan") < F.col("_share")).select("video_id", "user_id")
    many = user_rows.count()
    slots = video_rows.select("video_id", F.explode(F.sequence(F.lit(1), F.lit(extra))).alias("_k"))
    drawn = slots.withColumn("_rank", F.floor(uniform(seed, "extra", F.xxhash64("video_id", "_k")) * many))
    more = drawn.join(_ranked(user_rows, "user_id"), "_rank").select("video_id", "user_id")
    return audience.union(more).distinct()


def stream_events(spark: SparkSession, n: int, seed: int = 42, many_users: int = 2500, catalogue: int = 5000) -> DataFrame:
    """seq, user_id, user_type (30 of 100 premium), event_type, content_id (Zipf 1.15), priority."""
    u = lambda what: uniform(seed, what, F.col("id"))
    kind = weighted(STREAM_WEIGHTS, u("kind"))
    premium = u("premium") < 0.3
    return spark.range(n).select(
        F.col("id").alias("seq"),
        F.format_string("user_%05d", F.floor(u("user") * many_users)).alias("user_id"),
        F.when(premium, "premium").otherwise("standard").alias("user_type"),
        kind.alias("event_type"),
        F.format_string("title_%05d", zipf(catalogue, 1.15, u("item"), u("alias")) - 1).alias("content_id"),
        graded_priority(kind, premium).alias("priority"),
    )


def access_stream(spark: SparkSession, n: int, catalogue: int = 25_000, skew: float = 1.2, seed: int = 42) -> DataFrame:
    """(seq, item) with items by Zipf's law."""
    u = lambda what: uniform(seed, what, F.col("id"))
    return spark.range(n).select(F.col("id").alias("seq"), zipf(catalogue, skew, u("item"), u("alias")).alias("item"))


def duplicate_events(spark: SparkSession, n: int, many_users: int = 3000, content: int = 8000, hot: int = 40, share: float = 0.05, seed: int = 42) -> DataFrame:
    """(seq, token, ip): a share of the tokens is drawn from earlier rows, and of the addresses from a hot few."""
    u = lambda what, row: uniform(seed, what, row)
    i = F.col("id")
    origin = F.when((u("again", i) < share) & (i > 0), F.floor(u("which", i) * i)).otherwise(i).cast("long")
    rows = spark.range(n).select(i, origin.alias("_o"))
    o = F.col("_o")
    token = F.concat_ws(":", F.format_string("user_%05d", F.floor(u("user", o) * many_users)), F.format_string("title_%05d", F.floor(u("item", o) * content)), between(0, 500, u("number", o)).cast("string"))
    number = F.floor(u("ip", i) * F.when(u("hot", i) < share, hot).otherwise(600)).cast("long")
    ip = F.format_string("10.0.%d.%d", F.floor(number / 255), number % 255)
    return rows.select(i.alias("seq"), token.alias("token"), ip.alias("ip"))


def catalogue_titles(spark: SparkSession, size: int = 5000, seed: int = 42) -> DataFrame:
    """Distinct titles of an adjective, a noun, a suffix and a number to 999, in order.

    Each row takes another one of all such titles: its number times a factor that shares none
    with their count, modulo that count.
    """
    parts = (len(ADJECTIVES), len(NOUNS), len(SUFFIXES), 999)
    most = parts[0] * parts[1] * parts[2] * parts[3]
    if not 0 <= size <= most:
        raise ValueError(f"there are {most} titles")
    at = F.pmod((F.col("id") + seed * 7919) * 611_953, F.lit(most))
    words = []
    for values, many in zip((ADJECTIVES, NOUNS, SUFFIXES), parts, strict=False):
        words.append(F.get(F.array(*[F.lit(v) for v in values]), (at % many).cast("int")))
        at = F.floor(at / many)
    return spark.range(size).select(F.concat_ws(" ", *words, (at + 1).cast("string")).alias("title")).orderBy("title")


def prefix_queries(titles: DataFrame, count: int = 600, seed: int = 42) -> DataFrame:
    """`count` beginnings, 3 to 10 characters long, of titles taken by a hash, each as often as the next but for one."""
    rounds = -(-count // max(1, titles.count()))
    taken = titles.select("title", F.explode(F.sequence(F.lit(1), F.lit(max(1, rounds)))).alias("_k"))
    taken = taken.orderBy((F.col("_k") == rounds), F.xxhash64(F.lit(seed), "title", "_k"), "title").limit(count)
    n = between(3, 10, uniform(seed, "length", F.xxhash64("title", "_k")))
    return taken.select(F.substring(F.col("title"), F.lit(1), n).alias("query"))


def watch_histories(spark: SparkSession, many_users: int = 800, clusters: int = 12, titles: int = 40, watches: int = 18, noise: int = 1, seed: int = 42) -> DataFrame:
    """Distinct (user_id, title): most titles from the user's cluster, some from the next one and from anywhere."""
    slots = spark.range(many_users).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(watches + 2 * noise - 1))).alias("k"))
    r = uniform(seed, "title", F.xxhash64("u", "k"))
    home = F.col("u") % clusters
    cluster = F.when(F.col("k") < watches, home).when(F.col("k") < watches + noise, (home + 1) % clusters).otherwise(F.floor(uniform(seed, "any", F.xxhash64("u", "k")) * clusters))
    title = F.concat(F.lit("c"), cluster.cast("string"), F.lit("_t"), F.floor(r * titles).cast("string"))
    return slots.select(F.concat(F.lit("user_"), F.col("u").cast("string")).alias("user_id"), title.alias("title")).distinct()
