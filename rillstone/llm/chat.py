r"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A conversation is the string of its turns, in order; a turn is

    ### role LF body LF </turn> LF

Control strings are `### ` and `</turn>`, each with any backslashes before it.  The parser is
deterministic: it cuts at `LF </turn> LF`, takes the role up to the first line feed, and drops
one backslash before each control string of the body.  In a role, `%`, `#`, `<` and line feed
are percent-encoded.

The writer first puts a text in as it is, reparses the turn and compares it with the source; a
turn that came back different, or has a control string that no backslash guards, has every
control string of its text guarded by one more backslash, and is parsed and compared again.
One such round always ends it, since guarding is undone by dropping; `rounds` says which turns
needed it, and `round_trip` whether the whole string gives back the source.

Case by case: a null role or text is empty; turns are ordered by turn (null first), then role
and text; rows that repeat are turns each for itself; a null conversation is one conversation;
an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"### |</turn>"
END = "\n</turn>\n"
_ENCODED = (("%", "%25"), ("#", "%23"), ("<", "%3C"), ("\n", "%0A"))


def guarded(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unguarded(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def _role(role: Column) -> Column:
    for plain, code in _ENCODED:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _unrole(role: Column) -> Column:
    for plain, code in reversed(_ENCODED):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), _role(role), F.lit("\n"), body, F.lit(END))


def _blocks(formatted: Column) -> Column:
    """The turns' strings without their ends."""
    return F.filter(F.split(formatted, r"\n</turn>\n", -1), lambda x, i: F.length(x) > 0)


def _parsed(block: Column) -> Column:
    head = F.locate("\n", block) if isinstance(block, str) else F.instr(block, "\n")
    return F.struct(_unrole(F.substring(block, F.lit(5), head - 5)).alias("role"), unguarded(F.substring(block, head + 1, F.length(block))).alias("text"))


def parse(formatted: Column) -> Column:
    """The turns, as an array of (role, text), of a formatted conversation."""
    return F.transform(_blocks(formatted), _parsed)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, source (the turns), formatted, rounds (0 or 1 for each turn), round_trip."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("row"))
    source = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    source = source.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))

    def conflict(t: Column) -> Column:
        back = parse(_turn(t["role"], t["text"]))
        return (F.size(back) != 1) | (F.get(back, F.lit(0)) != t) | t["text"].rlike(rf"(?<!\\)({CONTROL})")

    first = source.withColumn("rounds", F.transform("source", lambda t: conflict(t).cast("int")))
    written = first.withColumn("formatted", F.array_join(F.zip_with("source", "rounds", lambda t, r: _turn(t["role"], F.when(r == 1, guarded(t["text"])).otherwise(t["text"]))), ""))
    return written.withColumn("round_trip", F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False)))


def masks(formatted: Column, role: str = "assistant") -> Column:
    """Loss mask: a run (skip, take) for each turn, in code points from the turn's start.

    `take` is the length of the body of a turn of this role, and 0 for others; what is left of a
    turn, its end string included, is skipped.
    """
    return F.transform(
        _blocks(formatted),
        lambda b: F.struct(F.instr(b, "\n").alias("skip"), F.when(_parsed(b)["role"] == role, F.length(b) - F.instr(b, "\n")).otherwise(0).alias("take")),
    )


def digests(chats: DataFrame, role: str = "assistant") -> DataFrame:
    """What the formatted strings give back, as digests."""
    read = chats.withColumn("turns", parse(F.col("formatted"))).withColumn("mask", masks(F.col("formatted"), role))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # each run is cut out of its own turn, so the time is linear in the conversation
    learnt = F.array_join(F.zip_with(_blocks(F.col("formatted")), "mask", lambda b, m: unguarded(F.substring(b, m["skip"] + 1, m["take"]))), "")
    return read.withColumn("learnt", learnt).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
