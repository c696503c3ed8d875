"""Text columns from generated answers: tagged expressions, code, fences, loose lists, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.stats import normal_text


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def expression(text: Column) -> Column:
    """The first <expr> of a text, else one with tags in any case, else a last line that looks like a call, else NULL."""
    last = F.trim(F.element_at(F.split(F.rtrim(F.regexp_replace(text, r"\s+$", "")), r"\n"), -1))
    return F.coalesce(F.trim(_found(text, r"(?s)<expr>(.*?)</expr>")), F.trim(_found(text, r"(?is)<expr>(.*?)</expr>")), F.when(last.rlike(r"^[A-Za-z_]\w*\(.*\)$"), last))


def code(text: Column, header: str = "class ") -> Column:
    return F.coalesce(F.trim(_found(text, r"(?s)<code>(.*?)</code>")), F.when(text.contains(header), text))


def fenced(text: Column) -> Column:
    """The body of the first fenced block, else the text."""
    return F.coalesce(F.trim(_found(text, r"(?is)```(?:yaml|yml|json)?\s*(.*?)```")), F.trim(text))


def listed(text: Column) -> Column:
    """Items of a comma list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def exact_hash(text: Column) -> Column:
    return F.substring(F.sha1(normal_text(text).cast("binary")), 1, 16)


def profile_hash(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def size_class(x: Column) -> Column:
    """Bucket of a constant in the structural family."""
    a = F.abs(x)
    return F.when(a <= 5, 0).when(a <= 20, 1).when(a <= 60, 2).when(a <= 120, 3).when(a <= 240, 4).otherwise(5)


def bar_label(minutes: Column) -> Column:
    """Whole days, else whole hours, else minutes."""
    days, hours = F.pmod(minutes, F.lit(1440)) == 0, F.pmod(minutes, F.lit(60)) == 0
    return F.when(days, F.format_string("%d-day", (minutes / 1440).cast("int"))).when(hours, F.format_string("%d-hour", (minutes / 60).cast("int"))).otherwise(F.format_string("%d-minute", minutes))


#: Windows that the lookback hint names.
HINT_WINDOWS = (20, 60, 120, 240)


def lookback_hint(minutes: Column) -> Column:
    """How long each window is: in whole days for bars of a day or more, else in whole hours."""
    daily = minutes >= 1440
    unit = F.when(daily, 1440).otherwise(60)
    parts = [F.concat(F.lit(f"{w} bars = "), F.floor(minutes * w / unit).cast("string"), F.when(daily, "d").otherwise("h")) for w in HINT_WINDOWS]
    return F.concat_ws(", ", *parts)


#: The keys of a loose candidate.
LOOSE_KEYS = ("name", "expr", "intuition", "category")
_PAIR = rf"^\s*-?\s*({'|'.join(LOOSE_KEYS)})\s*:\s*(.*)$"


def loose_candidates(df: DataFrame, key: str = "id", text: str = "body") -> DataFrame:
    """(key, idx, seed_id, name, expr, intuition, category) of candidates in texts of loose ``key: value`` lines.

    A line that begins with a dash starts an item, and so does a name once the item has an expr.  Items without
    an expr are left out but numbered; a text without items has no rows.  The lines of a text are folded in
    order within its row, without a shuffle.
    """
    lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda x: x.rlike(_PAIR))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(x, _PAIR, 2)), r'^"+|"+$', ""), r"^'+|'+$", "")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, _PAIR, 1).alias("k"), bare(x).alias("v"), F.ltrim(x).startswith("-").alias("dash")))
    shape = "struct<done:array<map<string,string>>,own:map<string,string>>"
    put_away = lambda acc: F.when(F.size(acc["own"]) > 0, F.concat(acc["done"], F.array(acc["own"]))).otherwise(acc["done"])

    def step(acc, x):
        new = x["dash"] | ((x["k"] == "name") & F.map_contains_key(acc["own"], F.lit("expr")))
        rest = F.map_filter(acc["own"], lambda k, _: k != x["k"])
        one = F.map_from_arrays(F.array(x["k"]), F.array(x["v"]))
        return F.struct(F.when(new, put_away(acc)).otherwise(acc["done"]).alias("done"), F.when(new, one).otherwise(F.map_concat(rest, one)).alias("own")).cast(shape)

    start = F.struct(F.array().cast("array<map<string,string>>").alias("done"), F.create_map().cast("map<string,string>").alias("own")).cast(shape)
    items = F.aggregate(pairs, start, step, put_away)
    rows = df.select(key, F.posexplode(items).alias("idx", "item")).where("coalesce(item['expr'], '') <> ''")
    number = F.format_string("seed_%04d", F.col("idx"))
    field = lambda n, other: F.coalesce(F.try_element_at("item", F.lit(n)), other)
    return rows.select(key, "idx", number.alias("seed_id"), field("name", number).alias("name"), F.col("item")["expr"].alias("expr"), field("intuition", F.lit("")).alias("intuition"), field("category", F.lit("general")).alias("category"))
