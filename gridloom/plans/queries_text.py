"""Masking, entity extraction, message parameters and keyword search over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import emissions as E
from gridloom.operators import masking as M
from gridloom.operators import retrieval as R
from gridloom.plans.registry import query, rounded
from gridloom.sources.tables import readings, table

PATTERN_SQL = r"""SELECT doc_id, kind, value FROM (
  SELECT doc_id, 'EMAIL' AS kind, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS value FROM documents
  UNION ALL SELECT doc_id, 'IP', unnest(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) FROM documents
  UNION ALL SELECT doc_id, 'TIMESTAMP', unnest(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\b')) FROM documents)"""


@query("extract_patterns", PATTERN_SQL)
def extract_patterns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.extract_patterns(docs).select("doc_id", "kind", "value")


@query("extract_timestamps", """SELECT event_id AS reading_id, 'TIMESTAMP' AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS value FROM events
UNION ALL SELECT event_id, 'IP', '10.' || (event_id % 200) || '.' || (event_id % 90) || '.7' FROM events""")
def extract_timestamps(spark, sf_dir):
    """Log lines made from readings: each holds a time and an address."""
    k = F.col("reading_id")
    line = F.concat(
        F.lit("reading at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" from 10."), (k % 200).cast("string"),
        F.lit("."), (k % 90).cast("string"), F.lit(".7 ok"),
    )
    logs = readings(spark, sf_dir).select("reading_id", line.alias("text"))
    return M.extract_patterns(logs).select("reading_id", "kind", "value")


# Spaces become blanks, other letters and digits an underscore, so that ASCII word ends are Unicode ones.
PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(text, '[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}\x{1c}-\x{1f}]', ' ', 'g'),
  '[^\p{L}\p{N}\x00-\x7f]', '-', 'g'), '[^\x00-\x7f]', '_', 'g')"""
ENTITY_PATTERN = r"\b[A-Z][a-zA-Z0-9]*(?:\s+[A-Z0-9][a-zA-Z0-9]*)*\b"
NAME_TESTS = " ".join(
    f"WHEN contains(key, '{n}') OR contains('{n}', key) THEN '{k}'" for n, k in (
        ("cambridge smelting co.", "FACILITY"), ("cambridge smelting", "FACILITY"), ("steel plant #4", "FACILITY"),
        ("steel plant", "FACILITY"), ("smelter 3b", "EQUIPMENT"), ("furnace 12", "EQUIPMENT"),
    )
)
AROUND = "facility|plant|smelter|furnace|meter|machine|compressor|boiler|turbine|site|co\\.|inc\\.|corp\\."


def entity_sql(rows: str, ids: str) -> str:
    """CTEs up to ``ents``: (ids, value, kind, start, i) of the table ``rows``; ``i`` orders a text's replacements."""
    return f"""plain AS (SELECT {ids}, text, {PLAIN} AS plain FROM {rows}),
hits AS (SELECT {ids}, text, unnest(list_zip(regexp_extract_all(plain, '{ENTITY_PATTERN}'), string_split_regex(plain, '{ENTITY_PATTERN}')[:-2])) AS hit,
  unnest(range(len(regexp_extract_all(plain, '{ENTITY_PATTERN}')))) AS spot FROM plain),
spots AS (SELECT {ids}, text, length(hit[1]) AS len, (sum(length(hit[1]) + length(hit[2])) OVER (PARTITION BY {ids} ORDER BY spot))::BIGINT - length(hit[1]) AS start FROM hits),
valued AS (SELECT *, substr(text, start + 1, len) AS value, lower(substr(text, start + 1, len)) AS key,
  lower(substr(text, greatest(start - 30, 0) + 1, start + len + 30 - greatest(start - 30, 0))) AS around FROM spots WHERE len >= 3),
kinds AS (SELECT {ids}, value, start, CASE {NAME_TESTS} WHEN regexp_matches(around, '{AROUND}') THEN
  CASE WHEN regexp_matches(key, 'plant|site|co|facility') THEN 'FACILITY' ELSE 'EQUIPMENT' END END AS kind FROM valued),
firsts AS (SELECT {ids}, value, arg_min(kind, start) AS kind, min(start) AS start FROM kinds WHERE kind IS NOT NULL GROUP BY {ids}, value),
ents AS (SELECT *, row_number() OVER (PARTITION BY {ids} ORDER BY length(value) DESC, start) AS i FROM firsts)"""


@query("extract_entities", f"WITH {entity_sql('documents', 'doc_id')} SELECT doc_id, value, kind, start FROM ents")
def extract_entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.extract_entities(docs).select("doc_id", "value", "kind", "start")


@query("assign_placeholders", f"""WITH p AS ({PATTERN_SQL}), f AS (SELECT source, doc_id, kind, value, strpos(text, value) AS spot,
  CASE kind WHEN 'EMAIL' THEN 0 WHEN 'IP' THEN 1 ELSE 2 END AS phase FROM (SELECT DISTINCT * FROM p) JOIN documents USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY source, value ORDER BY doc_id, phase, spot) AS r FROM f),
n AS (SELECT source, value, kind, row_number() OVER (PARTITION BY source ORDER BY doc_id, phase, spot) - 1 AS number FROM o WHERE r = 1)
SELECT source, value, '[REDACTED_' || kind || '_' || number || ']' AS placeholder FROM n""")
def assign_placeholders(spark, sf_dir):
    """Patterns only, one session per document source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = M.find_sensitive(docs, names=[], indicators=[])
    return M.assign_placeholders(found, "source", "doc_id").select("source", "value", "placeholder")


@query("mask_documents", f"""WITH p AS ({PATTERN_SQL}), f AS (SELECT source, doc_id, kind, value, strpos(text, value) AS spot,
  CASE kind WHEN 'EMAIL' THEN 0 WHEN 'IP' THEN 1 ELSE 2 END AS phase FROM (SELECT DISTINCT * FROM p) JOIN documents USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY source, value ORDER BY doc_id, phase, spot) AS r FROM f),
n AS (SELECT source, value, kind, row_number() OVER (PARTITION BY source ORDER BY doc_id, phase, spot) - 1 AS number FROM o WHERE r = 1),
m AS (SELECT f.doc_id, list(struct_pack(v := f.value, p := '[REDACTED_' || n.kind || '_' || number || ']') ORDER BY f.phase, f.spot) AS l
      FROM f JOIN n ON n.source = f.source AND n.value = f.value GROUP BY f.doc_id)
SELECT doc_id, CASE WHEN l IS NULL THEN text ELSE list_reduce(list_prepend(struct_pack(v := '', p := text), l),
  lambda a, b: struct_pack(v := '', p := replace(a.p, b.v, b.p))).p END AS masked FROM documents LEFT JOIN m USING (doc_id)""")
def mask_documents(spark, sf_dir):
    """Whole documents with e-mails, addresses and times replaced per source session."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    masked, _ = M.mask_messages(docs, "source", "doc_id", ["doc_id"], names=[], indicators=[])
    return masked.select("doc_id", "masked")


def _marked(texts: str, hits: str, mark: str) -> str:
    """``texts`` with each of the list ``hits`` replaced by the mark."""
    return f"""list_reduce(list_prepend(struct_pack(v := '', p := {texts}), list_transform({hits}, lambda h: struct_pack(v := {mark[0]}, p := {mark[1]}))),
  lambda a, b: struct_pack(v := '', p := replace(a.p, b.v, b.p))).p"""


def _phase(number: int, kind: str, pattern: str) -> str:
    mark = ("h", f"'[REDACTED_{kind}_0]'")
    return f"""s{number} AS (SELECT conv_id, turn, text, lists, hits, {_marked('plain', 'hits', mark)} AS plain FROM (
  SELECT *, regexp_extract_all(plain, '{pattern}') AS hits FROM (SELECT conv_id, turn, text, plain, lists FROM r{number - 1}))),
r{number} AS (SELECT conv_id, turn, text, plain, list_concat(lists, list_transform(hits, lambda h, n: struct_pack(phase := {number}, i := n, v := h, k := '{kind}'))) AS lists FROM s{number})"""


@query("mask_messages", rf"""WITH {entity_sql('conversations', 'conv_id, turn')},
gathered AS (SELECT conv_id, turn, list(struct_pack(phase := 0, i := i, v := value, k := kind) ORDER BY i) AS lists FROM ents GROUP BY ALL),
r0 AS (SELECT conv_id, turn, text, {_marked("coalesce(text, '')", 'lists', ("h.v", "'[REDACTED_' || h.k || '_0]'"))} AS plain, lists
  FROM (SELECT conv_id, turn, text, coalesce(lists, []) AS lists FROM conversations LEFT JOIN gathered USING (conv_id, turn))),
{_phase(1, 'EMAIL', r'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')},
{_phase(2, 'IP', r'\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}')},
{_phase(3, 'TIMESTAMP', r'\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}')},
found AS (SELECT conv_id, turn, v, arg_min(k, (phase, i)) AS k, min((phase, i)) AS o FROM (SELECT conv_id, turn, unnest(lists, max_depth := 2) FROM r3) GROUP BY ALL),
firsts_ AS (SELECT conv_id, v, arg_min(k, (turn, o)) AS k, min((turn, o)) AS o FROM found GROUP BY ALL),
named AS (SELECT conv_id, v, '[REDACTED_' || k || '_' || (row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1) || ']' AS p FROM firsts_),
pairs AS (SELECT conv_id, turn, list(struct_pack(v := v, p := p) ORDER BY o) AS l FROM found JOIN named USING (conv_id, v) GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN l IS NULL THEN coalesce(text, '') ELSE
  {_marked("text", "l", ("h.v", "h.p"))} END AS masked FROM conversations LEFT JOIN pairs USING (conv_id, turn)""")
def mask_messages(spark, sf_dir):
    """Entities and patterns, one session per conversation."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    masked, _ = M.mask_messages(chats, "conv_id", "turn", ["conv_id", "turn"])
    return masked.select("conv_id", "turn", "masked")


@query("unmask_round_trip", "SELECT conv_id, turn, text AS restored FROM conversations")
def unmask_round_trip(spark, sf_dir):
    """Masking and restoring gives the original texts back."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    masked, mapping = M.mask_messages(chats, "conv_id", "turn", ["conv_id", "turn"])
    out = M.unmask(masked, mapping, "conv_id", ["conv_id", "turn"])
    return out.select("conv_id", "turn", "restored")


@query("mask_nested", r"""SELECT event_id, event_type AS kind, round_even(value * 2, 0) / 2 AS kwh, round_even((value + 0.5) * 2, 0) / 2 AS shifted,
  'from [REDACTED_IP]' AS note, user_id FROM events""")
def mask_nested(spark, sf_dir):
    """A nested payload: strings masked, fractions coarsened, integers kept."""
    e = table(spark, sf_dir, "events")
    payload = F.struct(
        F.col("event_type").alias("kind"), F.col("user_id"), F.array(F.col("value"), F.col("value") + 0.5).alias("loads"),
        F.create_map(F.lit("note"), F.concat(F.lit("from 10.0.0."), (F.col("user_id") % 200).cast("string"))).alias("tags"),
    )
    df = e.select("event_id", payload.alias("payload"))
    out = df.select("event_id", M.mask_nested(F.col("payload"), df.schema["payload"].dataType, M.hide_patterns).alias("p"))
    return out.select(
        "event_id", "p.kind", F.col("p.loads")[0].alias("kwh"), F.col("p.loads")[1].alias("shifted"),
        F.col("p.tags")["note"].alias("note"), "p.user_id",
    )


@query("coarsen", "SELECT event_id, round_even(value * 2, 0) / 2 AS kwh FROM events")
def coarsen(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.coarsen(F.col("value")).alias("kwh"))


WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda w: w <> ''))"
DOCS_SQL = f"""d AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(text) AS body, source AS category,
  {WORDS.format("split_part(text, chr(10), 1)")} AS tw, {WORDS.format('text')} AS bw FROM documents)"""


@query("token_overlap", f"""SELECT doc_id, len(list_intersect({WORDS.format("split_part(text, chr(10), 1)")}, {WORDS.format('text')})) AS overlap FROM documents""")
def token_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n", 2)[0].alias("title"))
    return R.token_overlap(docs, "title", "text").select("doc_id", F.col("overlap").cast("bigint").alias("overlap"))


def _queries_docs(spark, sf_dir):
    """Every third question names a category; documents of that source rank higher."""
    item = F.col("item_id")
    category = F.when(item % 3 == 0, F.concat(F.lit("SRC"), (item % 20).cast("string")))
    asked = table(spark, sf_dir, "benchmark").select(item.alias("query_id"), "text", category.alias("category"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.split("text", "\n", 2)[0].alias("title"), F.col("text").alias("body"), F.col("source").alias("category")
    )
    return asked, docs


@query("keyword_search", f"""WITH q AS (SELECT item_id AS query_id, {WORDS.format('text')} AS terms, CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 20) END AS category FROM benchmark),
{DOCS_SQL}, s AS (SELECT query_id, doc_id, CASE WHEN q.category = lower(d.category) THEN 8 ELSE 0 END + 4 * len(list_intersect(terms, tw)) + 2 * len(list_intersect(terms, bw))
  + CASE WHEN len(list_filter(terms, lambda t: contains(title, t) OR contains(body, t))) > 0 THEN 3 ELSE 0 END AS score FROM q CROSS JOIN d)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""")
def keyword_search(spark, sf_dir):
    asked, docs = _queries_docs(spark, sf_dir)
    return R.keyword_search(asked, docs, 5)


@query("extract_params", r"""SELECT conv_id, turn, CASE WHEN t LIKE '%leak%' OR t LIKE '%anomaly%' OR t LIKE '%waste%' THEN 'anomaly'
  WHEN t LIKE '%forecast%' OR t LIKE '%tomorrow%' OR t LIKE '%predict%' THEN 'forecast' WHEN t LIKE '%shift%' OR t LIKE '%schedule%' OR t LIKE '%optimize%' THEN 'schedule'
  WHEN t LIKE '%solar%' OR t LIKE '%twin%' OR t LIKE '%battery%' OR t LIKE '%scenario%' THEN 'scenario' ELSE 'compliance' END AS intent,
  TRY_CAST(regexp_extract(t, '(\d+(?:\.\d+)?)\s*(?:kw|kilowatt|load)', 1) AS DOUBLE) AS load_kw, TRY_CAST(regexp_extract(t, '(\d+)\s*(?:hour|hr|h|duration)', 1) AS DOUBLE) AS duration_h,
  TRY_CAST(regexp_extract(t, '(\d+(?:\.\d+)?)\s*(?:kw\s*solar|solar\s*capacity|solar)', 1) AS DOUBLE) AS solar_kw,
  TRY_CAST(regexp_extract(t, '(\d+(?:\.\d+)?)\s*(?:kwh\s*battery|battery|storage)', 1) AS DOUBLE) AS battery_kwh
FROM (SELECT conv_id, turn, lower(text) || CASE turn % 4 WHEN 0 THEN ' optimize 120.5 kW for ' || (conv_id % 9) || ' hours' WHEN 1 THEN ' with 300 solar and ' || (conv_id % 50) || ' kwh battery'
  WHEN 2 THEN ' predict tomorrow' ELSE '' END AS t0, lower(t0) AS t FROM conversations)""")
def extract_params(spark, sf_dir):
    """Requests appended to the chat texts, so that each kind of number occurs."""
    c = table(spark, sf_dir, "conversations")
    ask = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" optimize 120.5 kW for "), (F.col("conv_id") % 9).cast("string"), F.lit(" hours")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit(" with 300 solar and "), (F.col("conv_id") % 50).cast("string"), F.lit(" kwh battery")))
        .when(F.col("turn") % 4 == 2, F.lit(" predict tomorrow")).otherwise(F.lit(""))
    )
    out = E.extract_params(c.select("conv_id", "turn", F.concat("text", ask).alias("text")))
    return out.select("conv_id", "turn", "intent", "load_kw", "duration_h", "solar_kw", "battery_kwh")


@query("built_in_functions", """SELECT event_id, upper(substr(event_type, 1, 3)) AS code, CAST(strpos(props, 'k') AS INTEGER) AS at,
  strftime(ts, '%Y-%m-%d %H:%M') AS label, CAST(dayofyear(ts) AS INTEGER) AS doy, round(exp(-value / 100), 8) AS decay, round(ln(value + 1), 8) AS log_kwh,
  CAST(ceil(value) AS BIGINT) AS up, replace(event_type, 'i', '-') AS dashed FROM events""")
def built_in_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.upper(F.substring("event_type", 1, 3)).alias("code"), F.instr("props", "k").alias("at"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("label"), F.dayofyear("ts").alias("doy"),
        F.exp(-F.col("value") / 100).alias("decay"), F.ln(F.col("value") + 1).alias("log_kwh"),
        F.ceil("value").alias("up"), F.replace(F.col("event_type"), F.lit("i"), F.lit("-")).alias("dashed"),
    )
    return rounded(e, 8, "decay", "log_kwh")
