"""Reversible masking of sensitive text: entities, patterns, placeholders, restore.

Texts stay where they are: built-in functions find entities and patterns per text.
Only the distinct (session, value) pairs are shuffled to be numbered, and numbering works
on chunks, so a session holding a large share of all texts is not gathered in one task.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.arrays import with_running_sums
from gridloom.operators.series import with_position
from gridloom.session import cut_lineage

# --- Fixed values: patterns, known names, indicator words ------------------------------
PATTERNS = [
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("IP", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("TIMESTAMP", r"\b\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\b"),
]
ENTITY = r"\b[A-Z][a-zA-Z0-9]*(?:\s+[A-Z0-9][a-zA-Z0-9]*)*\b"
KNOWN_NAMES = [
    ("Cambridge Smelting Co.", "FACILITY"),
    ("Cambridge Smelting", "FACILITY"),
    ("Steel Plant #4", "FACILITY"),
    ("Steel Plant", "FACILITY"),
    ("Smelter 3B", "EQUIPMENT"),
    ("Smelter 3b", "EQUIPMENT"),
    ("Furnace 12", "EQUIPMENT"),
]
INDICATORS = [
    "facility", "plant", "smelter", "furnace", "meter", "machine", "compressor",
    "boiler", "turbine", "site", "co.", "inc.", "corp.",
]
FACILITY_MARKS = ["plant", "site", "co", "facility"]
CONTEXT_CHARS = 30
# --- End of fixed values ------------------------------------------------------------

UNICODE = "(?U)"  # word and space classes as in Unicode text


FOUND_TYPE = "array<struct<kind:string,value:string>>"


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def extract_patterns(df: DataFrame, text="text", patterns=PATTERNS) -> DataFrame:
    """One row per match with ``kind`` and ``value``."""
    found = F.flatten(
        F.array(*[
            F.transform(
                F.regexp_extract_all(F.col(text), F.lit(UNICODE + p), F.lit(0)), _tagged(k)
            )
            for k, p in patterns
        ])
    )
    return df.withColumn("_f", F.explode(found)).withColumn("kind", F.col("_f.kind")).withColumn(
        "value", F.col("_f.value")
    ).drop("_f")


#: ``ENTITY`` for the JVM: a capitalised word and the capitalised words and numbers after it, each taken whole, so that
#: long runs need no stack.  Letters and digits of any script end no word.
_WORD_END = r"(?![\p{L}\p{N}_])"
_WORD_START = r"(?U)(?=[A-Z])(?<![\p{L}\p{N}_])"
_WORDS = r"[A-Z][a-zA-Z0-9]*+" + _WORD_END + r"(?:[\s\x1c-\x1f]++[A-Z0-9][a-zA-Z0-9]*+" + _WORD_END + ")*+"
_ENTITY = _WORD_START + _WORDS
#: The same with the characters before (group 1 or 2) and after it (group 3).
_IN_CONTEXT = (
    _WORD_START + rf"(?s:(?<=(.{{{CONTEXT_CHARS}}}))|(?<=\A(.{{0,{CONTEXT_CHARS - 1}}})))" + _WORDS + rf"(?s:(?=(.{{0,{CONTEXT_CHARS}}})))"
)

_WIDE = r"[\x{10000}-\x{10FFFF}]"


def _any_of(tests) -> Column:
    return functools.reduce(operator.or_, tests, F.lit(False))


def _kind(key: Column, around: Column, names, indicators) -> Column:
    """The kind of the first known name that holds the value or is held by it, else by the words around; or null.

    Both texts are in lower case.
    """
    chain = F
    for name, kind in names:
        name = name.lower()
        chain = chain.when(key.contains(name) | F.lit(name).contains(key), F.lit(kind))
    marked = F.when(_any_of(key.contains(w) for w in FACILITY_MARKS), F.lit("FACILITY")).otherwise(F.lit("EQUIPMENT"))
    return chain.when(_any_of(around.contains(w) for w in indicators), marked)


def _with_entities(df: DataFrame, text: str, names, indicators, with_start: bool) -> DataFrame:
    """Adds ``_entities``: distinct sensitive word groups (value, kind, start), longest first, then first place.

    ``start`` counts characters from the beginning, or word groups if ``with_start`` is False,
    which saves a pass over the text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    # looking back counts UTF-16 units: characters of two units become others of their class
    narrow = F.when(whole.rlike(_WIDE), F.regexp_replace(
        F.regexp_replace(whole, rf"[\p{{L}}\p{{N}}&&{_WIDE}]", "_"), _WIDE, "-"
    )).otherwise(whole)

    def around(group):
        """The context only where the text has an indicator at all."""
        return F.when(F.col("_has"), F.regexp_extract_all(narrow, F.lit(_IN_CONTEXT), F.lit(group))).otherwise(F.array().cast("array<string>"))

    helpers = ["_value", "_far", "_edge", "_after"]
    out = df.withColumn("_low", F.lower(whole))
    out = out.withColumn("_has", _any_of(F.col("_low").contains(w) for w in indicators)).drop("_low")
    out = out.withColumns({"_value": F.regexp_extract_all(whole, F.lit(_ENTITY), F.lit(0)), "_far": around(1), "_edge": around(2), "_after": around(3)})
    if with_start:
        gaps = F.transform(F.split(whole, _ENTITY, -1), lambda x: F.length(x))
        steps = F.zip_with(F.slice(gaps, 1, F.size("_value")), F.concat(F.array(F.lit(0)), F.transform("_value", lambda v: F.length(v))),
                           lambda gap, before: (gap + before).cast("long"))
        out = out.withColumn("_steps", F.slice(steps, 1, F.size("_value")))
        out = with_running_sums(out, "_steps", "_start")
    else:
        out = out.withColumn("_start", F.transform("_value", lambda v, i: i.cast("long")))
    def before(s):
        """Group 2 may be left over from an earlier place; from the 30th character on group 1 is set."""
        return F.when(s["_far"] != "", s["_far"]).otherwise(s["_edge"])

    spots = F.arrays_zip("_value", "_far", "_edge", "_after", "_start")
    lowered = F.transform(spots, lambda s: F.struct(
        s["_value"].alias("value"), s["_start"].alias("start"), F.lower(s["_value"]).alias("key"),
        F.lower(F.concat_ws("", before(s), s["_value"], s["_after"])).alias("around"),
    ))
    judged = F.transform(lowered, lambda s: F.struct(
        s["value"].alias("value"), s["start"].alias("start"), _kind(s["key"], s["around"], names, indicators).alias("kind")
    ))
    kept = F.array_sort(F.filter(judged, lambda e: e["kind"].isNotNull() & (F.length(e["value"]) >= 3)))
    out = out.withColumn("_kept", kept).drop(*helpers, "_has", "_start")
    # of each value the first place that counts
    first = F.filter("_kept", lambda e, i: (i == 0) | (F.get("_kept", i - 1)["value"] != e["value"]))
    ordered = F.array_sort(F.transform(first, lambda e: F.struct(
        (-F.length(e["value"])).alias("l"), e["start"].alias("start"), e["value"].alias("value"), e["kind"].alias("kind")
    )))
    return out.withColumn("_entities", ordered).drop("_kept")


def extract_entities(df: DataFrame, text="text", names=KNOWN_NAMES, indicators=INDICATORS) -> DataFrame:
    """One row per distinct entity of a text: ``value``, ``kind`` and first ``start``.

    An entity is a run of capitalised words of three characters at least that shares a known
    name or stands near an indicator word.  Null and empty texts have none.
    """
    spans = _with_entities(df, text, list(names), list(indicators), with_start=True)
    # an inner explode, or a filter on the lists, would be pushed down and search the texts again
    each = spans.withColumn("_e", F.explode_outer("_entities")).where("_e IS NOT NULL")
    return each.withColumns(
        {"value": F.col("_e.value"), "kind": F.col("_e.kind"), "start": F.col("_e.start").cast("int")}
    ).drop("_e", "_entities")


def _find_patterns(df: DataFrame, text: str, patterns, earlier: Column) -> DataFrame:
    """``found``: ``earlier`` finds, then those of the patterns.

    Each pattern is searched in the text left by the finds before it.
    """
    start = F.aggregate(
        earlier, F.coalesce(F.col(text), F.lit("")),
        lambda t, e: F.replace(t, e["value"], F.concat(F.lit("[REDACTED_"), e["kind"], F.lit("_0]"))),
    )
    out, found = df.withColumn("_left", start), [earlier]
    for i, (kind, pattern) in enumerate(patterns):
        hits = F.array_distinct(F.regexp_extract_all("_left", F.lit(UNICODE + pattern), F.lit(0)))
        if "@" in pattern:  # few texts hold one, and the search for what stands before it is slow
            hits = F.when(F.col("_left").contains("@"), hits).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(f"_h{i}", hits)
        mark = F.lit(f"[REDACTED_{kind}_0]")
        out = out.withColumn("_left", _replaced(F.col("_left"), F.col(f"_h{i}"), mark))
        found.append(F.transform(f"_h{i}", _tagged(kind)))
    return out.withColumn("found", F.concat(*found)).drop("_left", *(f"_h{i}" for i in range(len(patterns))))


def _replaced(text: Column, values: Column, mark: Column) -> Column:
    return F.aggregate(values, text, lambda t, v: F.replace(t, v, mark))


def find_sensitive(df: DataFrame, text="text", names=KNOWN_NAMES, indicators=INDICATORS, patterns=PATTERNS):
    """Adds ``found``: the values to mask in the order of replacement, entities first.

    Patterns are searched in the text whose earlier finds are already replaced.
    """
    names, indicators, patterns = list(names), list(indicators), list(patterns)
    if not names and not indicators:
        return _find_patterns(df, text, patterns, F.array().cast(FOUND_TYPE))
    spans = _with_entities(df, text, names, indicators, with_start=False)
    spans = spans.withColumn("_named", F.transform("_entities", lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"))))
    return _find_patterns(spans, text, patterns, F.col("_named")).drop("_named", "_entities")


def assign_placeholders(found: DataFrame, session: str, order: str, slot_width: int = 1024) -> DataFrame:
    """(session, value) -> placeholder; ids count up per session in order of appearance.

    ``found`` has one row per text with ``found``; ``order`` is an integer that orders the
    texts of a session.  A value keeps the kind of its first appearance.
    """
    each = found.select(session, F.col(order).alias("_o"), F.posexplode("found").alias("_i", "_f"))
    first = each.groupBy(session, F.col("_f.value").alias("value")).agg(
        F.min(F.struct(F.col("_o"), F.col("_i"), F.col("_f.kind").alias("kind"))).alias("_m")
    ).select(session, "value", "_m.*")
    numbered = with_position(first, [session], ["_o", "_i"], width=slot_width)
    name = F.concat(F.lit("[REDACTED_"), F.col("kind"), F.lit("_"), F.col("_pos").cast("string"), F.lit("]"))
    return numbered.select(session, "value", "kind", F.col("_pos").alias("number"), name.alias("placeholder"))


def replace_all(text: Column, pairs: Column, old: str, new: str) -> Column:
    return F.aggregate(pairs, text, lambda t, e: F.replace(t, e[old], e[new]))


def found_table(df: DataFrame, session: str, order: str, text_id: Sequence[str], text="text", **kw) -> DataFrame:
    """(session, order, text_id, found) of the texts with finds, materialised without the
    texts, so that numbering and replacing do not search the texts again."""
    cols = list(dict.fromkeys([session, order, *text_id]))
    found = cut_lineage(find_sensitive(df.select(*dict.fromkeys([*cols, text])), text, **kw).select(*cols, "found"))
    return found.filter(F.size("found") > 0)


def mask(df: DataFrame, found: DataFrame, mapping: DataFrame, session: str, text_id: Sequence[str], text="text", name="masked"):
    """Replace each text's finds, in their order, by the session's placeholders.

    The list gathered per text is that text's own finds.
    """
    ids = list(text_id)
    each = found.select(session, *[c for c in ids if c != session], F.posexplode("found").alias("_i", "_f"))
    pairs = (
        each.withColumn("value", F.col("_f.value")).join(mapping.select(session, "value", "placeholder"), [session, "value"])
        .groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("_i", "value", "placeholder"))).alias("_pairs"))
    )
    out = df.join(pairs, ids, "left")
    done = F.when(F.col("_pairs").isNull(), F.col(text)).otherwise(
        replace_all(F.col(text), F.col("_pairs"), "value", "placeholder")
    )
    return out.withColumn(name, F.coalesce(done, F.lit(""))).drop("_pairs")


def unmask(df: DataFrame, mapping: DataFrame, session: str, text_id: Sequence[str], text="masked", name="restored"):
    """Put the originals back, longest placeholder first.

    Each text looks up the placeholders it contains, so the session's whole map is never
    gathered.
    """
    ids = list(text_id)
    marks = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\[REDACTED_[A-Z]+_\d+\]"), F.lit(0)))
    each = df.select(session, *[c for c in ids if c != session], F.explode(marks).alias("placeholder"))
    pairs = (
        each.join(mapping.select(session, "value", "placeholder"), [session, "placeholder"])
        .groupBy(*ids).agg(
            F.array_sort(F.collect_list(F.struct((-F.length("placeholder")).alias("_l"), "placeholder", "value"))).alias("_pairs")
        )
    )
    out = df.join(pairs, ids, "left")
    done = F.when(F.col("_pairs").isNull(), F.col(text)).otherwise(
        replace_all(F.col(text), F.col("_pairs"), "placeholder", "value")
    )
    return out.withColumn(name, done).drop("_pairs")


def mask_messages(df: DataFrame, session: str, order: str, text_id: Sequence[str], text="text", **kw):
    """(masked texts, mapping): the whole round for a table of messages."""
    found = found_table(df, session, order, text_id, text, **kw)
    mapping = assign_placeholders(found, session, order)
    return mask(df, found, mapping, session, text_id, text), mapping


def coarsen(col: Column, step=0.5) -> Column:
    return F.bround(col / F.lit(step)) * F.lit(step)


def mask_nested(col: Column, dtype: T.DataType, hide) -> Column:
    """Walk a nested column by its type: strings through ``hide``, fractions to steps of
    0.5, everything else untouched."""
    if isinstance(dtype, T.StringType):
        return hide(col)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return coarsen(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: mask_nested(x, dtype.elementType, hide))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: mask_nested(v, dtype.valueType, hide))
    if isinstance(dtype, T.StructType):
        made = F.struct(*[mask_nested(col[f.name], f.dataType, hide).alias(f.name) for f in dtype.fields])
        return F.when(col.isNotNull(), made)
    return col


def hide_patterns(col: Column, patterns=PATTERNS) -> Column:
    """Stateless masking for nested payloads: every pattern match becomes its kind."""
    for kind, pattern in patterns:
        col = F.regexp_replace(col, UNICODE + pattern, f"[REDACTED_{kind}]")
    return col
