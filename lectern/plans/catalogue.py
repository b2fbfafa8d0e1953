"""Queries of the review engine's operators on the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import session
from lectern.functions import bands, jsonx, usfm
from lectern.functions import sql as sql_functions
from lectern.functions.text import JS_SPACE, MISSING, js_int, missing_to_null, py_strip, reference_key
from lectern.operators import answers, lookup, order, quality, report, rounds, views, workflow
from lectern.plans import adapters, batch
from lectern.plans.adapters import DOMAIN_SQL
from lectern.schemas import REPORT, SEGMENT
from lectern.sources import readers, sinks
from lectern.streaming import reports as index_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def nullable(df: DataFrame, *columns: str) -> DataFrame:
    """Nullable numbers and booleans as strings, which every client reads back alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def query(sql: str | None = None, domain: bool = True):
    """Registers a query under its function's name, with the SQL (after the domain tables) that it must equal."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with {DOMAIN_SQL} {sql}" if domain else sql
        return f

    return add


@query("select conv_id as verse, coalesce(min(case when role <> 'system' then 1 + length(text) % 10 end), 0)::int as consensus, count(*) filter (where role <> 'system')::int as n_closings from conversations group by conv_id", domain=False)
def consensus_score(spark, sf_dir):
    rows = adapters.conversation_debates(spark, sf_dir).select("verse", jsonx.closings("closing_statements").alias("closings"))
    return rows.select("verse", report.consensus("closings").alias("consensus"), F.size("closings").alias("n_closings"))


@query("select chapter, verse, md5(text) as text_md5 from verses")
def usfm_roundtrip(spark, sf_dir):
    return adapters.verses(spark, sf_dir).select("chapter", "verse", F.md5("text").alias("text_md5"))


@query("select chapter, verse, count(*) as n, md5(arg_min(greek_text, row_ord)) as first_md5, arg_min(translation, row_ord) as translation from individual_multi group by chapter, verse having count(*) = 2")
def exact_pair_groups(spark, sf_dir):
    return lookup.debatable(adapters.individual(spark, sf_dir, multi=True)).select("chapter", "verse", "n", F.md5("first.greek_text").alias("first_md5"), F.col("first.translation").alias("translation"))


@query("select chapter, verse, count(*) as n from individual_multi group by chapter, verse having count(*) <> 2")
def skipped_groups(spark, sf_dir):
    return lookup.skipped(adapters.individual(spark, sf_dir, multi=True)).select("chapter", "verse", "n")


@query("select verse, md5(greek_text) as greek_md5, coalesce(face_annotation, 'Uncategorized') as face_annotation, min(row_ord) as ord, count(*) as n, arg_min(translation, row_ord) as translation from individual where greek_text is not null group by verse, greek_text, coalesce(face_annotation, 'Uncategorized')")
def segments_first_seen(spark, sf_dir):
    return report.segments(adapters.individual(spark, sf_dir)).select("verse", F.md5("greek_text").alias("greek_md5"), "face_annotation", "ord", "n", F.col("first.translation").alias("translation"))


def _verdict(k: str) -> str:
    return f"case when toxic = 1 and {k} = doc_id % 3 then null else quality = 1 and {k} > 0 or (doc_id + {k}) % 5 = 0 end"


@query(
    f"""select doc_id, case when v0 is null or v0 then 0 when v1 is null or v1 then 1 when v2 is null or v2 then 2 else 3 end::int as revisions,
    case when v0 is null then 'unparsable' when v0 then 'accepted' when v1 is null then 'unparsable' when v1 then 'accepted' when v2 is null then 'unparsable' when v2 then 'accepted' else 'exhausted' end as outcome
    from (select doc_id, {_verdict("0")} as v0, {_verdict("1")} as v1, {_verdict("2")} as v2 from labels)""",
    domain=False,
)
def review_loop(spark, sf_dir):
    revisions, outcome = workflow.review_outcome([F.expr(_verdict(str(k))) for k in range(workflow.MAX_REVIEWS)])
    return adapters.table(spark, sf_dir, "labels").select("doc_id", revisions.alias("revisions"), outcome.alias("outcome"))


@query(
    """select row_ord, agent_name, (case when s % 2 = 1 then s else s - 1 end)::int as score, (case when s % 2 = 1 then 0 else 1 end)::int as revisions, 'accepted' as outcome
    from (select row_ord, agent_name, 1 + ('0x' || substr(md5(agent_name || chr(10) || greek_text), 1, 8))::bigint % 10 as s from gt, agents)"""
)
def review_loop_udf(spark, sf_dir):
    rows = lookup.fan_out(adapters.truth(spark, sf_dir), batch.AGENTS).select("row_ord", "agent_name", F.col("greek_text").alias("prompt"))
    done = workflow.score_rows(rows, workflow.StubScorer())
    return done.select("row_ord", "agent_name", F.from_json("analysis", "score int, reasoning string")["score"].alias("score"), "revisions", "outcome")


@query(
    """select chapter, verse, 6 as n_turns, ((a + b) % 2 + (greatest(a - 1, 1) + greatest(b - 1, 1)) % 2)::int as n_interventions, 2 as n_closings, least(greatest(a - 1, 1), greatest(b - 1, 1))::int as consensus
    from (select chapter, verse, arg_min(score, row_ord) as a, arg_max(score, row_ord) as b from individual_multi group by chapter, verse having count(*) = 2)"""
)
def debate_udf(spark, sf_dir):
    held = report.decoded_debates(workflow.debates(adapters.individual(spark, sf_dir, multi=True), workflow.StubScorer()))
    stepped_in = F.size(F.filter("turns", lambda x: x["intervened"]))
    return held.select("chapter", "verse", F.size("turns").alias("n_turns"), stepped_in.alias("n_interventions"), F.size("closings").alias("n_closings"), "consensus")


@query("select g.row_ord, 'PHM ' || g.chapter || ':' || g.verse as ref, md5(v.text) as translation_md5 from gt g join verses v on g.chapter = v.chapter and g.verse = v.verse")
def strict_lookup(spark, sf_dir):
    """Documents without a word have no verse; all others must have theirs."""
    rows = adapters.truth(spark, sf_dir).filter(F.col("greek_text").rlike(JS_SPACE.replace("[", "[^\\\\", 1)))
    found = lookup.with_translation(rows, adapters.verses(spark, sf_dir))
    return found.select("row_ord", reference_key("PHM", "chapter", "verse").alias("ref"), F.md5("translation").alias("translation_md5"))


@query("select g.row_ord, g.chapter, g.verse from gt g semi join debated d on g.row_ord = d.doc_id")
def semi_translation(spark, sf_dir):
    known = adapters.table(spark, sf_dir, "labels").selectExpr("cast(doc_id div 50 + 1 as int) as chapter", "cast(doc_id % 50 + 1 as int) as verse")
    return lookup.translated(adapters.truth(spark, sf_dir), known).select("row_ord", "chapter", "verse")


_PROMPT_SQL = "printf('" + batch.PROMPT.replace("'", "''").replace("\n", "' || chr(10) || '") + "', 'Philemon', chapter, verse, greek_text, coalesce(face, ''), notes, 'tr ' || row_ord)"


@query(f"select row_ord, idx as agent_idx, agent_name, model, md5(p) as prompt_md5, (1 + ('0x' || substr(md5(p), 1, 8))::bigint % 10)::int as score from (select *, {_PROMPT_SQL} as p from gt) g, agents")
def score_fanout(spark, sf_dir):
    rows = adapters.truth(spark, sf_dir).withColumn("translation", F.expr("concat('tr ', row_ord)")).withColumn("prompt", batch.prompt())
    out = lookup.fan_out(rows, batch.AGENTS)
    return out.select("row_ord", "agent_idx", "agent_name", "model", F.md5("prompt").alias("prompt_md5"), workflow.prompt_score_column(F.col("prompt")).alias("score"))


_STRIP_SQL = r"regexp_replace({}, '^[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_SEGMENT_DEBATE_SQL = f"""seg as (
  select verse, greek_text, coalesce(face_annotation, 'Uncategorized') as face_annotation, min(row_ord) as ord, count(*) as n from individual where greek_text is not null group by verse, greek_text, coalesce(face_annotation, 'Uncategorized')
), deb as (
  select verse, {_STRIP_SQL.format("greek")} as greek, face, arg_min(a, doc_id) as a, arg_min(b, doc_id) as b, arg_min(toxic, doc_id) as toxic from debated where face is not null group by all
), met as (
  select s.*, d.verse is not null as has_debate, a, b, toxic from seg s left join deb d on s.verse = d.verse and {_STRIP_SQL.format("s.greek_text")} = d.greek and s.face_annotation = d.face
)"""


@query(f", {_SEGMENT_DEBATE_SQL} select ord, verse, md5(greek_text) as greek_md5, face_annotation, n, has_debate, least(a, b)::int::varchar as consensus, (case when has_debate then 2 end)::varchar as n_closings, (case when has_debate then 3 end)::varchar as n_turns from met")
def segment_debate_left(spark, sf_dir):
    rows = report.joined(adapters.individual(spark, sf_dir), adapters.debates(spark, sf_dir))
    size = lambda c: F.when(F.col("has_debate"), F.size(c))
    out = rows.select("ord", "verse", F.md5("greek_text").alias("greek_md5"), "face_annotation", "n", "has_debate", "consensus", size("closings").alias("n_closings"), size("turns").alias("n_turns"))
    return nullable(out, "consensus", "n_closings", "n_turns")


_TURNS_SQL = """turns as (select conv_id as verse, (row_number() over (partition by conv_id order by turn) - 1)::int as pos, case when role = 'system' then 'moderator' else 'linguist' end as role, case when role = 'system' then 'Moderator' else role end as agent,
  case when role <> 'system' then text end as argument, (case when role <> 'system' then 1 + length(text) % 10 end)::int as proposed_score, case when role = 'system' then role end as violators, case when role = 'system' then conv_id % 2 = 0 end as intervened, case when role = 'system' then text end as feedback from conversations)"""


def _conversation_turns(spark, sf_dir):
    rows = adapters.conversation_debates(spark, sf_dir).select("verse", F.posexplode(jsonx.turns("debate")).alias("pos", "t"))
    return rows.select("verse", "pos", "t.*")


@query(f"with {_TURNS_SQL} select verse, pos, role, agent, md5(argument) as argument_md5, proposed_score::varchar as proposed_score, violators, intervened::varchar as intervened, md5(feedback) as feedback_md5 from turns", domain=False)
def transcript_classified(spark, sf_dir):
    out = _conversation_turns(spark, sf_dir).select("verse", "pos", "role", "agent", F.md5("argument").alias("argument_md5"), "proposed_score", F.array_join("violators", ",").alias("violators"), "intervened", F.md5("feedback").alias("feedback_md5"))
    return nullable(out, "proposed_score", "intervened")


@query(f"with {_TURNS_SQL} select verse, pos, case when role = 'moderator' then 'M' else left(agent, 1) end as initial, md5(coalesce(nullif(argument, ''), feedback)) as body_md5, nullif(proposed_score, 0)::varchar as shown_score, violators as violations from turns where role <> 'moderator' or intervened", domain=False)
def visible_turns(spark, sf_dir):
    seen = views.visible_turns(_conversation_turns(spark, sf_dir))
    return nullable(seen.select("verse", "pos", "initial", F.md5("body").alias("body_md5"), "shown_score", "violations"), "shown_score")


@query("select chapter, verse, md5(string_agg('- **' || agent_name || '** (Initial Score: ' || score || '): ' || model_analysis, chr(10) order by row_ord)) as context_md5 from individual group by chapter, verse")
def opening_context(spark, sf_dir):
    return lookup.opening_context(adapters.individual(spark, sf_dir)).select("chapter", "verse", F.md5("context").alias("context_md5"))


@query("select row_ord, coalesce(face_annotation, 'Uncategorized') as face_annotation from individual")
def uncategorized_fill(spark, sf_dir):
    return report.filled(adapters.individual(spark, sf_dir)).select("row_ord", "face_annotation")


@query(
    """, scored as (select chapter, verse, min(score) as debate_score from individual_multi group by chapter, verse having count(*) = 2)
    select v.chapter, v.verse, md5(v.text) as text_md5, s.debate_score::varchar as debate_score, nullif(s.debate_score, 0)::varchar as score, case when s.debate_score is null then 'none' else greatest(1, least(10, s.debate_score))::varchar end as band,
    case when s.debate_score is null then 'gray' when s.debate_score >= 8 then 'green' when s.debate_score >= 6 then 'yellow' else 'red' end as badge, (case when s.debate_score <> 0 then least(s.debate_score * 10, 100) end)::varchar as width
    from verses v left join scored s on v.chapter = s.chapter and v.verse = s.verse"""
)
def verse_scoreboard(spark, sf_dir):
    pairs = adapters.individual(spark, sf_dir, multi=True).groupBy("chapter", "verse").agg(F.min("score").alias("debate_score"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return nullable(views.scoreboard(adapters.verses(spark, sf_dir), pairs).withColumn("text_md5", F.md5("text")).drop("text"), "debate_score", "score", "width")


_INDEX_SQL = """items as (select doc_id // 60 as file_ord, (case when doc_id // 60 = 3 then 0 else (doc_id // 60) % 7 + 1 end)::int as chapter, (doc_id % 25)::int as verse, doc_id, md5(text) as greek, source, lang, n_chars from documents),
found as (select chapter, verse, arg_max(doc_id, doc_id) as doc_id from items where chapter <> 0 and verse <> 0 group by chapter, verse)"""


@query(f"with {_INDEX_SQL} select f.chapter, f.verse, i.greek, 'tr ' || i.doc_id as translation, (case when i.doc_id % 3 <> 0 then i.n_chars % 11 end)::varchar as debate_score from found f join items i on f.doc_id = i.doc_id", domain=False)
def index_upsert_last_wins(spark, sf_dir):
    found = views.index(adapters.reports(spark, sf_dir))
    return nullable(found.select("chapter", "verse", "segment.greek", "segment.translation", views.first_debate("segment.analysis")["score"].alias("debate_score")), "debate_score")


@query(
    f""", {_INDEX_SQL} select v.chapter, v.verse, md5(v.text) as text_md5, (case when i.doc_id % 3 <> 0 then i.n_chars % 11 end)::varchar as debate_score, (case when i.doc_id is not null then 1 end)::varchar as n_individuals,
    i.source || ' (Score: ' || (i.n_chars % 12) || ')' as labels from verses v left join found f on v.chapter = f.chapter and v.verse = f.verse left join items i on f.doc_id = i.doc_id"""
)
def verse_detail(spark, sf_dir):
    return _details(views.detail(adapters.verses(spark, sf_dir), views.index(adapters.reports(spark, sf_dir))))


def _details(rows):
    count = F.when(F.col("individuals").isNotNull(), F.size("individuals"))
    out = rows.select("chapter", "verse", F.md5("text").alias("text_md5"), F.col("debate.score").alias("debate_score"), count.alias("n_individuals"), F.array_join("labels", ";").alias("labels"))
    return nullable(out, "debate_score", "n_individuals")


@query("select chapter, count(*) as n_verses, min(verse)::int as first_verse from verses group by chapter")
def chapter_counts(spark, sf_dir):
    return views.chapters(adapters.verses(spark, sf_dir))


@query("select coalesce(arg_min(chapter, row_ord), 1)::int as chapter, count(*) as n_rows from individual")
def report_chapter(spark, sf_dir):
    return adapters.individual(spark, sf_dir).agg(F.coalesce(F.min_by("chapter", "row_ord"), F.lit(1)).alias("chapter"), F.count(F.lit(1)).alias("n_rows"))


@query(
    """, keyed as (select *, coalesce(face_annotation, 'Uncategorized') as f from individual where greek_text is not null
    ), deb as (select (doc_id // 50 + 1)::int as chapter, verse, greek, face, arg_min(a, doc_id) as a, arg_min(b, doc_id) as b from (select *, """
    + _STRIP_SQL.format("greek")
    + """ as g from debated) where face is not null group by all
    ), seg as (select chapter, verse, greek_text, f, min(row_ord) as ord, arg_min(notes, row_ord) as notes from keyed group by chapter, verse, greek_text, f)
    select k.chapter, k.verse, md5(k.greek_text) as greek_md5, k.f as annotation, s.notes, 'individual' as type, k.model, k.score, 0 as n_turns, 0 as n_closings from keyed k join seg s on k.chapter = s.chapter and k.verse = s.verse and k.greek_text = s.greek_text and k.f = s.f
    union all
    select s.chapter, s.verse, md5(s.greek_text), s.f, s.notes, 'debate', null, least(d.a, d.b), 3, 2 from seg s join deb d on s.chapter = d.chapter and s.verse = d.verse and """
    + _STRIP_SQL.format("s.greek_text")
    + " = "
    + _STRIP_SQL.format("d.greek")
    + " and s.f = d.face"
)
def report_document(spark, sf_dir):
    made = report.documents(adapters.individual(spark, sf_dir), adapters.debates(spark, sf_dir), "Philemon", "Letters")
    read = made.select(F.from_json("json", REPORT, {"mode": "FAILFAST"}).alias("r")).select("r.chapter", F.explode("r.analysis").alias("s")).select("chapter", "s", F.explode("s.analysis").alias("e"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return read.select("chapter", "s.verse", F.md5("s.greek").alias("greek_md5"), "s.annotation", "s.notes", "e.type", "e.model", "e.score", size("e.debate_transcript").alias("n_turns"), size("e.closing_statements").alias("n_closings"))


@query(
    """with d as (select *, (case when doc_id // 60 = 3 then 0 else (doc_id // 60) % 7 + 1 end)::int as chapter, (doc_id % 25)::int as verse from documents)
    select 'L2' as rule, chapter, verse, 'annotation' as detail from d where lang = 'de'
    union all select 'L3', chapter, verse, 'score ' || (n_chars % 12) from d where n_chars % 12 < 2 or n_chars % 12 > 9
    union all select 'L6', chapter, verse, 'score' from d where doc_id % 3 <> 0 and n_chars % 5 = 0""",
    domain=False,
)
def quality_violations(spark, sf_dir):
    return quality.violations(adapters.reports(spark, sf_dir), low=2, high=9)


@query(
    """select conv_id, turn, case when n % 7 = 5 or conv_id % 6 = 5 then null when n % 7 = 0 and n % 4 < 2 then n % 4 = 1 when n % 7 in (1, 2) then n % 2 = 0 when n % 7 = 3 then case when role = 'user' then true when role = 'system' then false end
    when n % 7 = 4 and n % 3 < 2 then n % 3 = 1 when n % 7 = 6 and n % 5 < 2 then n % 5 = 1 end::varchar as accepted, md5(text) as text_md5 from (select *, length(text) as n from conversations)""",
    domain=False,
)
def critic_lax_bool(spark, sf_dir):
    """Each turn as a reviewer's answer, its text the reasoning: accepted as a boolean, a number, a fraction, a word, a
    number in quotes, or missing; reasoning that is no string makes it none."""
    accepted = "case n % 7 when 0 then string(n % 4) when 1 then string(n % 2 = 0) when 2 then if(n % 2 = 0, '\"YES\"', '\"off\"') when 3 then case role when 'user' then '\"On\"' when 'system' then '\"n\"' else concat('\"', role, '\"') end when 4 then concat(n % 3, '.0') when 6 then concat('\"', n % 5, '\"') end"
    reasoning = "if(conv_id % 6 = 5, to_json(array(text)), substr(to_json(array(text)), 2, length(to_json(array(text))) - 2))"
    rows = adapters.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", "role", "length(text) as n").selectExpr("*", f"concat('\n {{', coalesce(concat('\"accepted\": ', {accepted}, ', '), ''), '\"reasoning\": ', {reasoning}, '}}\t') as said")
    out = rows.select("conv_id", "turn", jsonx.review("said").alias("r"), "text")
    return nullable(out.select("conv_id", "turn", "r.accepted", F.md5(F.coalesce("r.reasoning", "text")).alias("text_md5")), "accepted")


@query("select doc_id, (n_chars % 13 - 1)::bigint as parsed, case when n_chars % 13 - 1 >= 8 then 'green' when n_chars % 13 - 1 >= 6 then 'yellow' else 'red' end as badge, case when n_chars % 13 - 1 >= 8 then 'green' else 'yellow' end as card, null::varchar as none from documents", domain=False)
def parse_int_js(spark, sf_dir):
    text = F.concat(F.lit("  "), (F.col("n_chars") % 13 - 1).cast("string"), F.lit(".7 points"))
    rows = adapters.table(spark, sf_dir, "documents").select("doc_id", text.alias("said"))
    out = rows.select("doc_id", js_int("said").alias("parsed"), bands.badge_band("said").alias("badge"), bands.card_band(js_int("said")).alias("card"), js_int(F.concat(F.lit("x"), "said")).alias("none"))
    return nullable(out, "none")


@query(f"select row_ord, 'PHM ' || chapter || ':' || verse as ref, md5({_PROMPT_SQL}) as prompt_md5 from gt")
def prompt_text(spark, sf_dir):
    rows = adapters.truth(spark, sf_dir).withColumn("translation", F.expr("concat('tr ', row_ord)"))
    return rows.select("row_ord", reference_key("PHM", "chapter", "verse").alias("ref"), F.md5(batch.prompt()).alias("prompt_md5"))


@query(
    """select event_id // 20 as cell, (case when (event_id // 20) % 11 = 3 then 0 else count(*) filter (event_id % 9 in (0, 1, 4, 8)) end)::int as n_items, (case when (event_id // 20) % 11 = 3 then 0 else count(*) filter (event_id % 9 in (0, 1)) end)::int as n_objects,
    case when (event_id // 20) % 11 = 3 then '' else coalesce(string_agg(props::json ->> 'k', ',' order by event_id) filter (event_id % 9 in (0, 1)), '') end as ks from events group by event_id // 20""",
    domain=False,
)
def lenient_json(spark, sf_dir):
    """Twenty events a cell. Their properties stand in a list as objects, as text of one, as text of a list of one, and cut
    off; beside them are instructions, numbers, text of numbers, nulls and blanks. One cell in eleven is no list."""
    text = lambda x: f"substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2)"
    forms = ["props", text("props"), text("left(props, length(props) - 1)"), text("concat('Now we transition to ', props)"), text("string(user_id)"), "string(user_id)", "'null'", text("' \n'"), text("concat('[', props, ']')")]
    item = "case event_id % 9 " + " ".join(f"when {i} then {x}" for i, x in enumerate(forms)) + " end"
    items = adapters.table(spark, sf_dir, "events").selectExpr("event_id", "event_id div 20 as cell", f"{item} as item")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"]), ", ")
    cells = items.groupBy("cell").agg(listed.alias("said")).select("cell", F.concat(F.when(F.col("cell") % 11 == 3, '{"x": [').otherwise("["), "said", F.when(F.col("cell") % 11 == 3, "]}").otherwise("]")).alias("said"))
    ks = F.expr(f"array_join(transform({jsonx.objects_sql('said')}, x -> variant_get(x, '$.k', 'string')), ',')")
    return cells.select("cell", F.size(jsonx.decoded_items("said")).alias("n_items"), F.size(jsonx.decoded_objects("said")).alias("n_objects"), ks.alias("ks"))


@query(f"select doc_id, case when source in ({', '.join(repr(x) for x in MISSING)}) then null else source end as source, md5({_STRIP_SQL.format('text')}) as stripped_md5 from documents", domain=False)
def missing_and_strip(spark, sf_dir):
    return adapters.table(spark, sf_dir, "documents").select("doc_id", missing_to_null("source").alias("source"), F.md5(py_strip("text")).alias("stripped_md5"))


@query("select (row_number() over (order by row_ord) - 1) as row_ord, agent_name, chapter, verse, md5(greek_text) as greek_md5, face_annotation, score from individual")
def csv_roundtrip(spark, sf_dir):
    """The reviews through the CSV writer and reader; cells hold line ends, quotes and commas."""
    path = sinks.scratch(spark, "csv")
    names = {c.lower(): c for c in readers.INDIVIDUAL}
    rows = adapters.individual(spark, sf_dir).withColumn("greek_text", F.concat(F.lit('"q", '), "greek_text"))
    sinks.csv(rows.select(*[F.col(c).alias(names.get(c, c)) for c in rows.columns]), path)
    sinks.gone_at_end(spark, path)
    back = readers.individual(spark, path)
    return back.select("row_ord", "agent_name", "chapter", "verse", F.md5(F.expr("substr(greek_text, 6)")).alias("greek_md5"), "face_annotation", "score")


@query("select distinct (case when doc_id // 60 = 3 then 0 else (doc_id // 60) % 7 + 1 end)::int as chapter, doc_id // 60 as file_ord, count(*) over (partition by doc_id // 60) as n from documents", domain=False)
def report_json_roundtrip(spark, sf_dir):
    """Reports through the JSON document writer and reader."""
    path = sinks.scratch(spark, "json")
    rows = adapters.reports(spark, sf_dir)
    sinks.json_documents(rows.select(jsonx.json_text(F.struct("file_ord", *[f.name for f in REPORT.fields])).alias("json")), path)
    sinks.gone_at_end(spark, path)
    back = spark.read.schema(f"file_ord long, book string, chapter int, category string, analysis array<{SEGMENT.simpleString()}>").json(path)
    return back.select("chapter", "file_ord", F.size("analysis").cast("long").alias("n"))


@query("select chapter, verse, concat_ws(' ', substr(m, 1, 8), substr(m, 9, 8), substr(m, 17, 8), '*', substr(m, 25, 8)) as text from (select doc_id // 50 + 1 as chapter, doc_id % 50 + 1 as verse, doc_id, md5(text) as m from documents) where doc_id % 3 <> 0", domain=False)
def usfm_files(spark, sf_dir):
    """Chapters as marked-up files, written and read: footnotes, glossary words, nested markers, empty repeats of verses, and
    each chapter a first time with other verses, which the second one resets."""
    path = sinks.scratch(spark, "usfm")
    m = F.md5("text")
    marked = F.format_string(r"\v %d %s\f + \ft note %s\f* %s \w gloss|x\w*\nd %s\nd* \q1 %s", (F.col("doc_id") % 50 + 1), *[F.substring(m, *x) for x in ((1, 8), (1, 32), (9, 8), (17, 8), (25, 8))])
    again = F.format_string("\\v %d \n", (F.col("doc_id") % 50 + 1))
    line = F.struct("doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(marked, F.lit("\n"), again)).otherwise("").alias("second"), F.format_string("\\v %d old\n", F.col("doc_id") % 50 + 1).alias("first"))
    chapters = adapters.table(spark, sf_dir, "documents").select((F.expr("doc_id div 50") + 1).alias("chapter"), line.alias("line")).groupBy("chapter").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    body = lambda c: F.array_join(F.transform("lines", lambda x: x[c]), "")
    chapters.select(F.concat(F.lit("\\c "), "chapter", F.lit("\n"), body("first"), F.lit("\\c "), "chapter", F.lit("\n\\p\n"), body("second")).alias("value")).write.text(path)
    sinks.gone_at_end(spark, path)
    return readers.usfm_verses(spark, path).select(F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), "text")


@query(f"with {_INDEX_SQL} select f.chapter, f.verse, i.greek, (case when i.doc_id % 3 <> 0 then i.n_chars % 11 end)::varchar as debate_score from found f join items i on f.doc_id = i.doc_id", domain=False)
def report_files_index(spark, sf_dir):
    """Reports as files of one document, read as such and indexed by the order of their names."""
    path = sinks.scratch(spark, "reports")
    rows = adapters.reports(spark, sf_dir)
    sinks.json_documents(rows.select("file_ord", jsonx.json_text(F.struct(*[f.name for f in REPORT.fields])).alias("json")), path, order="file_ord")
    sinks.gone_at_end(spark, path)
    found = views.index(readers.reports(spark, path))
    return nullable(found.select("chapter", "verse", "segment.greek", views.first_debate("segment.analysis")["score"].alias("debate_score")), "debate_score")


@query("select doc_id // 60 as file_ord, case when doc_id // 60 = 3 then 'no chapter' when (doc_id // 60) % 5 = 1 then 'no JSON of a report' else 'no list of segments' end as reason from documents where doc_id // 60 = 3 or (doc_id // 60) % 5 in (1, 2) group by all", domain=False)
def report_files_rejected(spark, sf_dir):
    """Report files that are broken, without a chapter, without segments: each is named, and the others are read."""
    path = sinks.scratch(spark, "broken")
    rows = adapters.reports(spark, sf_dir)
    whole = jsonx.json_text(F.struct(F.format_string("book %d", "file_ord").alias("book"), "chapter", "category", "analysis"))
    none = F.format_string('{"book": "book %d", "chapter": 2, "analysis": null}', F.col("file_ord"))
    text = F.when((F.col("file_ord") % 5 == 1) & (F.col("file_ord") != 3), F.concat(F.lit('{"chapter": '), F.col("file_ord").cast("string"))).when((F.col("file_ord") % 5 == 2) & (F.col("file_ord") != 3), none).otherwise(whole)
    sinks.json_documents(rows.select("file_ord", text.alias("json")), path, order="file_ord")
    sinks.gone_at_end(spark, path)
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0).alias("file"), F.regexp_extract("value", '(?:book |"chapter": )([0-9]+)', 1).cast("long").alias("file_ord"))
    return readers.rejected(spark, path).join(files, "file").select("file_ord", "reason")


@query(
    """select doc_id, case when doc_id % 4 = 0 then 'Moderator' when doc_id % 4 = 1 then source end as agent, case when doc_id % 4 = 0 then null when doc_id % 5 <> 0 then lang end as argument,
    (case when doc_id % 4 = 0 or doc_id % 7 = 0 then null else doc_id % 7 end)::varchar as score, case when doc_id % 4 <> 0 then null when doc_id % 3 = 0 then '' else 'B,C' end as violators, case when doc_id % 4 <> 0 then null when doc_id % 3 = 0 then '' else lang end as feedback,
    case when doc_id % 4 = 3 then 'Unknown' when doc_id % 4 = 1 then source end as closing_agent, case when doc_id % 5 <> 0 then lang else '' end as statement from documents where doc_id % 4 <> 2""",
    domain=False,
)
def missing_keys(spark, sf_dir):
    """Items without some of their keys, with nulls, and with scores as numbers, fractions and strings. In turns an item
    without agent_name and intervene is none; in closings a missing agent is unknown."""
    d = "doc_id"
    agent = f"case when {d} % 4 = 1 then concat('\"agent_name\": \"', source, '\", ') when {d} % 4 = 2 then '' when {d} % 4 = 0 then '\"intervene\": true, ' else '\"agent_name\": null, ' end"
    argument = f"case when {d} % 4 = 0 and {d} % 3 <> 0 then concat('\"violators\": [\"B\", \"C\"], \"feedback\": \"', lang, '\", ') else '' end, case when {d} % 5 <> 0 then concat('\"argument\": \"', lang, '\", ') when {d} % 2 = 0 or {d} % 4 = 0 then '' else '\"argument\": null, ' end"
    score = f"case when {d} % 7 = 0 then 'null' when {d} % 3 = 0 then concat('\"', {d} % 7, '\"') when {d} % 3 = 1 then concat({d} % 7, '.9') else string({d} % 7) end"
    closing_agent = f"case when {d} % 4 = 1 then concat('\"agent_name\": \"', source, '\", ') when {d} % 4 = 3 then '' else '\"agent_name\": null, ' end"
    statement = f"case when {d} % 5 <> 0 then concat('\"argument\": \"', lang, '\", ') else '' end"
    rows = adapters.table(spark, sf_dir, "documents").selectExpr(d, f"concat('[{{', {agent}, {argument}, '\"proposed_score\": ', {score}, '}}, {{\"other\": 1}}]') as turns", f"concat('[{{', {closing_agent}, {statement}, '\"x\": 1}}]') as closings")
    got = rows.select(d, jsonx.turns("turns").alias("t"), F.get(jsonx.closings("closings"), F.lit(0)).alias("c")).select(d, F.inline("t"), "c")
    out = got.select(d, "agent", "argument", F.col("proposed_score").alias("score"), F.array_join("violators", ",").alias("violators"), "feedback", F.col("c.agent").alias("closing_agent"), F.col("c.statement").alias("statement"))
    return nullable(out, "score")


@query("select min(row_ord) over (partition by verse, greek_text, coalesce(face_annotation, 'Uncategorized')) as ord, row_number() over (partition by verse, greek_text, coalesce(face_annotation, 'Uncategorized') order by row_ord) - 1 as pos, model, score, model_analysis as reasoning from individual where greek_text is not null")
def ordered_entries(spark, sf_dir):
    rows = report.segments(adapters.individual(spark, sf_dir).orderBy(F.md5(F.col("row_ord").cast("string"))))
    return rows.select("ord", F.posexplode("entries").alias("pos", "e")).select("ord", F.col("pos").cast("long").alias("pos"), "e.model", "e.score", "e.reasoning")


_BREACHES = """with d as (select *, (doc_id % 9)::int as chapter, (doc_id % 25 + 1)::int as verse from documents)
    select 'L1' as rule, (case when doc_id % 11 <> 0 then chapter end)::varchar as chapter, null::varchar as verse, concat_ws(',', case when doc_id % 7 = 0 then 'book' end, case when doc_id % 11 = 0 then 'chapter' end, case when doc_id % 13 = 0 then 'category' end) as detail from d where doc_id % 7 = 0 or doc_id % 11 = 0 or doc_id % 13 = 0
    union all select 'L4', (case when doc_id % 11 <> 0 then chapter end)::varchar, verse::varchar, concat_ws(',', case when doc_id % 5 = 1 then 'score' end, case when doc_id % 6 = 1 then 'closing_statements' end) from d where doc_id % 5 = 1 or doc_id % 6 = 1
    union all select 'L5', (case when doc_id % 11 <> 0 then chapter end)::varchar, verse::varchar, 'turn of ' || case doc_id % 4 when 1 then 'judge' when 2 then 'no role' else 'linguist' end from d where doc_id % 4 in (1, 2, 3)"""


@query(_BREACHES, domain=False)
def schema_breaches(spark, sf_dir):
    """Reports without fields of their own, of debates and of turns (a judge's, one without a role, one without an agent)."""
    turn = "named_struct('role', case doc_id % 4 when 1 then 'judge' when 2 then null else 'linguist' end, 'agent', if(doc_id % 4 = 3, null, 'A'))"
    entry = f"named_struct('type', 'debate', 'score', if(doc_id % 5 = 1, null, 3), 'debate_transcript', array({turn}), 'closing_statements', if(doc_id % 6 = 1, null, array()))"
    segment = f"named_struct('verse', cast(doc_id % 25 + 1 as int), 'greek', 'g', 'translation', 't', 'annotation', 'a', 'notes', null, 'analysis', array({entry}))"
    whole = f"to_json(named_struct('book', if(doc_id % 7 = 0, null, 'b'), 'chapter', if(doc_id % 11 = 0, null, cast(doc_id % 9 as int)), 'category', if(doc_id % 13 = 0, null, 'c'), 'analysis', array({segment})))"
    rows = adapters.table(spark, sf_dir, "documents").select(F.from_json(F.expr(whole), REPORT).alias("r")).select("r.*")
    return nullable(quality.violations(rows), "chapter", "verse")


_SCORED = "1 + ('0x' || substr(md5(agent_name || chr(10) || {}), 1, 8))::bigint % 10"
_RUN_SQL = ", rows as (select g.*, v.text as translation from gt g join verses v on g.chapter = v.chapter and g.verse = v.verse), scored as (select r.chapter, r.verse, r.row_ord, r.face, a.idx, " + _SCORED.format(_PROMPT_SQL.replace("'tr ' || row_ord", "translation")) + " as s from rows r, agents a), reviewed as (select *, case when s % 2 = 1 then s else s - 1 end as score from scored)"


@query(_RUN_SQL + " select chapter, verse, arg_min(score, idx)::int as first, arg_max(score, idx)::int as second, (case when any_value(face) is not null then least(greatest(arg_min(score, idx) - 1, 1), greatest(arg_max(score, idx) - 1, 1)) end)::int::varchar as consensus from reviewed where verse is not null group by chapter, verse, row_ord")
def batch_run(spark, sf_dir):
    """The whole run, from annotations and verses to reports: reviews of both agents and the debate's consensus, read from
    the report documents. A debate of a segment without an annotation doesn't attach."""
    _, _, made = batch.run(adapters.truth(spark, sf_dir).drop("n_chars"), adapters.verses(spark, sf_dir), on_missing="skip")
    parts = made.select(F.from_json("json", REPORT, {"mode": "FAILFAST"}).alias("r")).select("r.chapter", F.explode("r.analysis").alias("s"))
    own = views.individuals("s.analysis")
    out = parts.select("chapter", "s.verse", F.get(own, F.lit(0))["score"].alias("first"), F.get(own, F.lit(1))["score"].alias("second"), views.first_debate("s.analysis")["score"].alias("consensus"))
    return nullable(out, "consensus")


@query("select chapter, verse, md5('Source: ' || coalesce(arg_min(greek_text, row_ord), '') || chr(10) || 'Translation: ' || arg_min(translation, row_ord) || chr(10) || 'Annotation: ' || coalesce(arg_min(coalesce(face_annotation, ''), row_ord), '') || chr(10) || string_agg('- **' || agent_name || '** (Initial Score: ' || score || '): ' || model_analysis, chr(10) order by row_ord) || chr(10) || '" + lookup.TASK + "') as context_md5 from individual group by chapter, verse")
def debate_context(spark, sf_dir):
    return lookup.debate_context(adapters.individual(spark, sf_dir)).select("chapter", "verse", F.md5("context").alias("context_md5"))


@query("select chapter, verse, case when count(*) = 2 then 'debated' else 'skipped: ' || count(*) || ' of 2 reviews' end as said from individual_multi group by chapter, verse")
def run_trace(spark, sf_dir):
    return lookup.trace(adapters.individual(spark, sf_dir, multi=True))


@query("select chapter, verse, row_number() over (partition by chapter order by verse) as place, min(chapter) over () as first_chapter from verses")
def verse_order(spark, sf_dir):
    known = sinks.materialise(adapters.verses(spark, sf_dir).select("chapter", "verse"), "places")
    first = views.first_chapter(known).first().chapter
    return views.numbered(known).select("chapter", "verse", F.col("place").cast("long").alias("place"), F.lit(first).alias("first_chapter"))


@query(f"with {_INDEX_SQL} select f.chapter, f.verse, i.source as model, (i.n_chars % 12)::varchar as score, null::varchar as next_model from found f join items i on f.doc_id = i.doc_id", domain=False)
def verse_chosen(spark, sf_dir):
    """The chosen model's entry of a verse; a second one isn't there."""
    found = views.index(adapters.reports(spark, sf_dir))
    verses = found.select("chapter", "verse", F.lit("").alias("text"))
    first, second = (views.detail(verses, found, chosen=k).select("chapter", "verse", "chosen") for k in (0, 1))
    out = first.join(second.withColumnRenamed("chosen", "next"), ["chapter", "verse"])
    return nullable(out.select("chapter", "verse", "chosen.model", "chosen.score", F.col("next.model").alias("next_model")), "score")


@query("select row_ord, chapter, verse from gt")
def strict_keys(spark, sf_dir):
    """Keys as a file has them, with white space around, cast strictly."""
    rows = adapters.truth(spark, sf_dir).select("row_ord", *[F.format_string(" %d ", c).alias(c) for c in ("chapter", "verse")])
    return lookup.strict_keys(rows, "chapter", "verse")


@query("select distinct 'Philemon' as book, 'Letters' as category, (doc_id // 50 + 1)::int as chapter from documents where text is not null", domain=False)
def report_heads(spark, sf_dir):
    made = report.documents(adapters.individual(spark, sf_dir), adapters.debates(spark, sf_dir), "Philemon", "Letters")
    return made.select(F.from_json("json", REPORT).alias("r")).select("r.book", "r.category", "r.chapter")


@query("select doc_id, (case when n_chars % 2 = 0 then n_chars else -n_chars end)::bigint as hex, (4294967296 + n_chars)::bigint as large from documents where n_chars is not null", domain=False)
def parse_int_forms(spark, sf_dir):
    """Sizes in hexadecimal, of either sign and case and with a unit, and numbers of more than 32 bits."""
    rows = adapters.table(spark, sf_dir, "documents").filter("n_chars is not null")
    hex_ = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("\t0x"), F.hex("n_chars"), F.lit("px"))).otherwise(F.concat(F.lit("-0X"), F.lower(F.hex("n_chars"))))
    return rows.select("doc_id", js_int(hex_).alias("hex"), js_int(F.concat((F.lit(4294967296) + F.col("n_chars")).cast("string"), F.lit("e5"))).alias("large"))


@query(
    """with d as (select *, doc_id // 60 as file_ord, '/analysis/' || (doc_id % 60) as here from documents), files as (select distinct file_ord from d),
    found as (
      select file_ord, '/book' as pointer, 'type' as rule, 'number' as detail, 'L1' as part from files where file_ord % 4 = 1
      union all select file_ord, '/chapter', 'required', 'missing', 'L1' from files where file_ord % 3 = 2
      union all select file_ord, here || '/verse', 'type', 'string', 'L2' from d where doc_id % 7 = 3
      union all select file_ord, here || '/annotation', 'type', 'null', 'L2' from d where lang = 'de'
      union all select file_ord, here || '/analysis/0/score', case when n_chars % 12 < 1 then 'minimum' else 'maximum' end, (n_chars % 12)::varchar, 'L3' from d where doc_id % 11 <> 5 and n_chars % 12 in (0, 11)
      union all select file_ord, here || '/analysis/0', 'oneOf', 'no branch fits', 'L2' from d where doc_id % 11 = 5
      union all select file_ord, here || '/analysis/1/score', 'type', 'number', 'L4' from d where doc_id % 6 = 1
      union all select file_ord, here || '/analysis/1/debate_transcript/0/role', 'enum', '"judge"', 'L5' from d where doc_id % 5 = 1
      union all select file_ord, here || '/analysis/1/debate_transcript/1', 'type', 'number', 'L5' from d where doc_id % 13 = 2
      union all select file_ord, here || '/analysis/1/closing_statements/0/score', 'required', 'missing', 'L6' from d where doc_id % 8 = 4
    ) select file_ord::bigint as file_ord, pointer, rule, detail, part from found""",
    domain=False,
)
def report_schema_errors(spark, sf_dir):
    """Report files with wrong types, entries of no kind, extra turns and missing fields, checked as they are by the schema
    document."""
    path = sinks.scratch(spark, "faulty")
    q = lambda x: f"to_json(named_struct({x}), map('ignoreNullFields', 'false'))"
    first = "concat('{\"type\": \"', if(doc_id % 11 = 5, 'other', 'individual'), '\", \"model\": \"m\", \"reasoning\": \"r\", \"score\": ', n_chars % 12, '}')"
    turn = "concat('{\"role\": \"', if(doc_id % 5 = 1, 'judge', 'linguist'), '\", \"agent\": \"A\", \"proposed_score\": null}', if(doc_id % 13 = 2, ', 7', ''))"
    second = f"concat('{{\"type\": \"debate\", \"score\": ', if(doc_id % 6 = 1, '2.5', '2.0'), ', \"debate_transcript\": [', {turn}, '], \"closing_statements\": [{{\"agent\": \"A\", \"statement\": \"\"', if(doc_id % 8 = 4, '', ', \"score\": 3'), '}}]}}')"
    head = q("'greek', text, 'translation', 't', 'annotation', if(lang = 'de', null, source), 'notes', 'n'")
    segment = f"concat(left({head}, length({head}) - 1), ', \"verse\": ', if(doc_id % 7 = 3, '\"4\"', '4'), ', \"analysis\": [', {first}, ', ', {second}, ']}}')"
    rows = adapters.table(spark, sf_dir, "documents").selectExpr("doc_id div 60 as file_ord", "doc_id", f"{segment} as segment")
    held = rows.groupBy("file_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "segment"))), lambda x: x["segment"]), ", ").alias("segments"))
    text = "concat('{\"file_ord\": ', file_ord, if(file_ord % 3 = 2, '', ', \"chapter\": 1'), ', \"category\": \"c\", \"book\": ', if(file_ord % 4 = 1, '1', '\"b\"'), ', \"analysis\": [', segments, ']}')"
    sinks.json_documents(held.selectExpr("file_ord", f"{text} as json"), path, order="file_ord")
    sinks.gone_at_end(spark, path)
    files = readers.report_texts(spark, path).select(F.expr("variant_get(parse_json(content), '$.file_ord', 'long')").alias("file_ord"), "content")
    return quality.breaches(files)


@query(f"with {_INDEX_SQL} select f.chapter, f.verse, i.greek, (case when i.doc_id % 3 <> 0 then i.n_chars % 11 end)::varchar as debate_score from found f join items i on f.doc_id = i.doc_id", domain=False)
def index_batches(spark, sf_dir):
    """The index from three batches of reports, each of which rewrites the buckets that it touches."""
    path = sinks.scratch(spark, "index")
    rows = adapters.reports(spark, sf_dir)
    for k, which in enumerate(("file_ord < 4", "file_ord between 4 and 9", "file_ord > 9")):
        index_files.merge(spark, path, rows.filter(which), k, buckets=16)
    sinks.gone_at_end(spark, path)
    found = index_files.snapshot(spark, path)
    return nullable(found.select("chapter", "verse", "segment.greek", views.first_debate("segment.analysis")["score"].alias("debate_score")), "debate_score")


@query("select sha256('models' || chr(10) || text) as id, count(*) as asked from documents where text is not null and text not in (select text from documents where doc_id % 3 = 0 and text is not null) group by text", domain=False)
def pending_requests(spark, sf_dir):
    """What a run still has to ask: each document's text is a request, and those that documents divisible by three make were
    answered by a run before it, whose table holds them."""
    path = sinks.scratch(spark, "answers")
    rows = adapters.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").alias("request"), answers.request_id("text", "models").alias("id"))
    rows.filter("doc_id % 3 = 0").select("id", F.lit("answer").alias("answer"), F.lit(None).cast("string").alias("error")).write.parquet(path)
    sinks.gone_at_end(spark, path)
    return answers.pending(rows, answers.known(spark, path)).select("id", "asked")


_OUTCOME_SQL = "case when v0 is null or v0 then 0 when v1 is null or v1 then 1 when v2 is null or v2 then 2 else 3 end"


@query(
    f"""with v as (select doc_id, {_verdict("0")} as v0, {_verdict("1")} as v1, {_verdict("2")} as v2 from labels), o as (select *, {_OUTCOME_SQL} as n from v)
    select o.doc_id, n::int as revisions, case when n = 3 then 'exhausted' when (case n when 0 then v0 when 1 then v1 else v2 end) is null then 'unparsable' else 'accepted' end as outcome,
      (2 + 2 * n + case when n < 3 then 1 else 0 end)::int as n_messages,
      md5(text || ' ' || case when n = 0 then 'first' else 'revision ' || (n - 1) end) as last_md5,
      md5(text || chr(10) || text || ' first' || case when n >= 1 then chr(10) || 'no 0' || chr(10) || text || ' revision 0' else '' end || case when n >= 2 then chr(10) || 'no 1' || chr(10) || text || ' revision 1' else '' end || case when n >= 3 then chr(10) || 'no 2' || chr(10) || text || ' revision 2' else '' end) as told_md5
    from o join documents d on o.doc_id = d.doc_id where text is not null""",
    domain=False,
)
def review_frontier(spark, sf_dir):
    """The review loop round by round, from recorded answers: labels say what the reviewer said of each document in each
    round (accepted, rejected, or something that is no review). told_md5 is of the task, analyses and reasons in order."""
    docs = adapters.table(spark, sf_dir, "labels").join(adapters.table(spark, sf_dir, "documents"), "doc_id").filter("text is not null")
    rows = docs.select(F.col("doc_id").alias("key"), F.lit("A").alias("agent_name"), F.col("text").alias("prompt"))
    review = lambda k: f"case when {_verdict(k)} is null then 'nothing to say' else concat('{{\"accepted\": ', {_verdict(k)}, ', \"reasoning\": \"no {k}\"}}') end"
    told = [("score", 0, "concat(text, ' first')"), *((kind, k, f"concat(text, ' revision {k}')" if kind == "revise" else review(str(k))) for k in range(workflow.MAX_REVIEWS) for kind in ("review", "revise"))]
    record = docs.select(F.col("doc_id").alias("key"), F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("round"), F.expr(x).alias("answer")) for kind, k, x in told])))
    out = rounds.review_rounds(rows, rounds.by_record(record))
    said = F.transform(F.filter("history", lambda m: (m["speaker"] != "critic") | m["content"].like('{"accepted": false%')), lambda m: F.when(m["speaker"] == "critic", F.get_json_object(m["content"], "$.reasoning")).otherwise(m["content"]))
    return out.select(F.col("key").alias("doc_id"), "revisions", "outcome", F.size("history").alias("n_messages"), F.md5("analysis").alias("last_md5"), F.md5(F.array_join(said, "\n")).alias("told_md5"))


_PAIRS_SQL = "pairs as (select chapter, verse, arg_min(agent_name, row_ord) as one, arg_max(agent_name, row_ord) as two, arg_min(score, row_ord) as a, arg_max(score, row_ord) as b from individual_multi group by chapter, verse having count(*) = 2)"


@query(
    f""", {_PAIRS_SQL}, t as (select unnest(range(8))::int as turn)
    select chapter, verse, turn, case when turn in (2, 5) then 'moderator' when turn in (0, 3, 6) then one else two end as speaker,
      md5(chapter || ':' || verse || ' says ' || turn) as content_md5 from pairs, t"""
)
def debate_turn_log(spark, sf_dir):
    """Debates turn by turn from recorded answers; the log is begun, and gone on with by a second run."""
    path = sinks.scratch(spark, "turns")
    rows = adapters.individual(spark, sf_dir, multi=True)
    key = F.concat_ws(":", "chapter", "verse")
    turns = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("round")
    verses = rows.select("chapter", "verse").distinct().select(key.alias("key"), turns)
    kinds = F.when(F.col("round").isin(2, 5), "moderate").when(F.col("round") > 5, "close").otherwise("argue")
    record = verses.select("key", "round", kinds.alias("kind"), F.concat("key", F.lit(" says "), F.col("round").cast("string")).alias("answer"))
    rounds.debate_turns(rows, rounds.by_record(record), path, upto=3)
    sinks.gone_at_end(spark, path)
    log = rounds.debate_turns(rows, rounds.by_record(record), path)
    return log.select("chapter", "verse", "turn", "speaker", F.md5("content").alias("content_md5"))


@query("select (row_number() over (order by doc_id) - 1) as row_ord, (doc_id // 50 + 1)::int as chapter, (doc_id % 50 + 1)::int as verse, md5('\"q, ' || text) as greek_md5, case when doc_id % 5 = 0 then null else source end as face, case when doc_id % 7 = 0 then null else lang end as notes from documents where text is not null", domain=False)
def ground_truth_files(spark, sf_dir):
    """Annotated segments through a CSV table with quotes, commas, line ends and cells that mean nothing, read with strict
    keys."""
    path = sinks.scratch(spark, "truth")
    rows = adapters.table(spark, sf_dir, "documents").filter("text is not null").selectExpr("doc_id as row_ord", "doc_id div 50 + 1 as Chapter", "concat(' ', doc_id % 50 + 1, ' ') as Verse", "concat('\"q, ', text) as GreekText", "if(doc_id % 5 = 0, 'N/A', source) as Face", "if(doc_id % 7 = 0, 'nan', lang) as Notes")
    sinks.csv(rows, path)
    sinks.gone_at_end(spark, path)
    return readers.ground_truth(spark, path).select("row_ord", "chapter", "verse", F.md5("greek_text").alias("greek_md5"), "face", "notes")


@query(
    """select doc_id as row_ord, (doc_id // 50 + 1)::int as chapter, '' as translation, (case when doc_id % 4 = 0 then 0 when doc_id % 4 = 1 then n_chars % 9 else least(n_chars % 9, doc_id % 10) end)::int as consensus,
    2::int as n_closings, (case when doc_id % 4 = 3 then 0 else 1 end)::int as n_turns from documents where text is not null""",
    domain=False,
)
def debate_files(spark, sf_dir):
    """Debates through a CSV table without a column for translations, which then are empty; closing statements without a
    score count for nothing, and where none has one the consensus is 0. A debate's cell may be missing."""
    path = sinks.scratch(spark, "debated")
    score = lambda none, x: f"concat('\\\\\"proposed_score\\\\\": ', if({none}, 'null', string({x})))"
    closing = lambda who, none, x: f"concat('\"{{\\\\\"agent_name\\\\\": \\\\\"{who}\\\\\", ', {score(none, x)}, '}}\"')"
    closings = f"concat('[\"Now we transition to closing\", ', {closing('A', 'doc_id % 4 = 0', 'n_chars % 9')}, ', ', {closing('B', 'doc_id % 4 < 2', 'doc_id % 10')}, ']')"
    turns = "if(doc_id % 4 = 3, null, '[\"{\\\\\"agent_name\\\\\": \\\\\"A\\\\\"}\", 5, \"broken {\"]')"
    rows = adapters.table(spark, sf_dir, "documents").filter("text is not null").selectExpr("doc_id as row_ord", "doc_id div 50 + 1 as Chapter", "doc_id as Verse", "source as Face_Annotation", "text as Greek_Text", f"{turns} as Debate", f"{closings} as Closing_Statements")
    sinks.csv(rows, path)
    sinks.gone_at_end(spark, path)
    back = report.decoded_debates(readers.debates(spark, path))
    return back.select(F.col("verse").cast("long").alias("row_ord"), "chapter", "translation", "consensus", F.size("closings").alias("n_closings"), F.size("turns").alias("n_turns"))


@query(
    f""", {_SEGMENT_DEBATE_SQL}, firsts as (select coalesce(arg_min(chapter, row_ord), 1)::int as chapter from individual)
    select 'Philemon' as book, (select chapter from firsts) as chapter, (row_number() over (order by ord) - 1)::int as pos, verse, md5(greek_text) as greek_md5, face_annotation as annotation, n::int as n_individuals, least(a, b)::int::varchar as consensus from met"""
)
def report_whole(spark, sf_dir):
    """One report over all reviews, written in parts and read back from them as one document, a segment a line; its chapter is the first
    review's."""
    path = sinks.scratch(spark, "whole")
    parts = report.document_parts(adapters.individual(spark, sf_dir), adapters.debates(spark, sf_dir), "Philemon", "Letters")
    sinks.ordered_text(parts, path, "part", "ord")
    sinks.gone_at_end(spark, path)
    read = readers.report_of_parts(spark, path).withColumnRenamed("segment", "s")
    own = views.individuals("s.analysis")
    out = read.select("book", "chapter", "pos", "s.verse", F.md5("s.greek").alias("greek_md5"), "s.annotation", F.size(own).alias("n_individuals"), views.first_debate("s.analysis")["score"].alias("consensus"))
    return nullable(out, "consensus")


@query("select doc_id, row_number() over (order by source nulls first, n_chars, doc_id) - 1 as place from documents", domain=False)
def dense_ordinals(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return order.numbered(rows, "source", "n_chars", "doc_id").select("doc_id", "place")


#: Bytes of text a file of usfm_large_file: two splits of Spark's default size.
LARGE_FILE = 256 << 20


@query("select chapter, verse, md5(text) as text_md5 from verses")
def usfm_large_file(spark, sf_dir):
    """All chapters in files larger than a split, which are split at chapter markers; a repeat of each chapter's beginning
    comes before it. A task writes a file, so their number grows with the texts."""
    path = sinks.scratch(spark, "large")
    rows = adapters.truth(spark, sf_dir).select("chapter", "verse", F.col("greek_text").alias("text"), F.lit("PHM").alias("book"))
    chapters = usfm.render(rows, ["book", "chapter"])
    old = F.concat(F.lit("\\c "), F.col("chapter").cast("string"), F.lit("\n\\cl Heading\n\\v 1 an older text\n\\v 99 gone\n"))
    files = rows.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("text")) / LARGE_FILE))).first()[0]
    sinks.ordered_text(chapters.select(F.concat(old, "content").alias("text"), "chapter"), path, "chapter", parts=files)
    sinks.gone_at_end(spark, path)
    return readers.usfm_verses_of_large_files(spark, path).select("chapter", "verse", F.md5("text").alias("text_md5"))


@query(
    """select doc_id, case when doc_id % 3 = 0 then lang else source end as agent, (case when doc_id % 4 in (1, 2) then null else n_chars % 9 end)::varchar as score,
    case when doc_id % 5 = 0 then 'NaN and Infinity' else 'b' end as statement, (case when doc_id % 7 = 0 then 2 else 1 end)::int as n from documents where source is not null and lang is not null""",
    domain=False,
)
def python_json_cells(spark, sf_dir):
    """Closing statements with repeated keys (the last one counts), NaN and Infinity as values and in strings, plain and
    encoded twice."""
    session.python_json(spark)
    agent = "concat('\"agent_name\": \"', source, '\"', if(doc_id % 3 = 0, concat(', \"agent_name\": \"', lang, '\"'), ''))"
    score = "case doc_id % 4 when 1 then 'NaN' when 2 then '-Infinity' else string(n_chars % 9) end"
    item = f"concat('{{', {agent}, ', \"argument\": \"', if(doc_id % 5 = 0, 'NaN and Infinity', 'b'), '\", \"proposed_score\": ', {score}, '}}')"
    rows = adapters.table(spark, sf_dir, "documents").filter("source is not null and lang is not null").selectExpr("doc_id", f"{item} as item")
    twice = "concat('[', if(doc_id % 2 = 0, item, substr(to_json(array(item)), 2, length(to_json(array(item))) - 2)), if(doc_id % 7 = 0, ', {\"x\": NaN}', ''), ']')"
    got = rows.selectExpr("doc_id", f"{twice} as cell").select("doc_id", jsonx.closings("cell").alias("c"))
    out = got.select("doc_id", F.get("c", F.lit(0)).alias("c"), F.size("c").alias("n")).select("doc_id", "c.agent", "c.score", "c.statement", "n")
    return nullable(out, "score")


@query(
    """select conv_id as verse, coalesce(min(case when role <> 'system' then 1 + length(text) % 10 end), 0)::int as consensus, count(*) filter (where role = 'system')::int as n_moderations,
    greatest(1, least(10, coalesce(min(case when role <> 'system' then 1 + length(text) % 10 end), 0)))::varchar as band, conv_id::bigint as parsed from conversations group by conv_id""",
    domain=False,
)
def sql_surface(spark, sf_dir):
    """Consensus and bands of debates, written in SQL over the session's functions."""
    sql_functions.register(spark)
    said = adapters.conversation_debates(spark, sf_dir)
    return spark.sql(
        """select verse, consensus(debate_closings(closing_statements)) as consensus, size(filter(debate_turns(debate), t -> t.role = 'moderator')) as n_moderations,
        verse_band(consensus(debate_closings(closing_statements))) as band, js_int(concat('  ', verse, 'px')) as parsed from {said}""",
        said=said,
    )


@query(SQL["usfm_roundtrip"], domain=False)
def verses_in_sql(spark, sf_dir):
    """Files parsed by the session's function, in SQL."""
    sql_functions.register(spark)
    files = adapters.scripture(spark, sf_dir)
    said = spark.sql("select inline(said) from (select usfm_verses(content) as said from {files})", files=files)
    return said.select("chapter", "verse", F.md5("text").alias("text_md5"))


@query("select distinct doc_id // 50 + 1 as chapter, case (doc_id // 50) % 4 when 0 then 'empty' when 1 then 'no chapter' else 'no verse with text' end as reason from documents where (doc_id // 50) % 4 < 3", domain=False)
def usfm_files_rejected(spark, sf_dir):
    """Marked-up files, one a chapter, of which only each fourth has verses."""
    path = sinks.scratch(spark, "rejected")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a stated number, which small rows don't lower: what takes time is a folder each
    chapters = adapters.table(spark, sf_dir, "documents").select((F.expr("doc_id div 50") + 1).alias("chapter")).repartition(tasks, "chapter").distinct()
    text = "case (chapter - 1) % 4 when 0 then '\t ' when 1 then '\\\\v 1 text' when 2 then '\\\\c 1 \\\\v 1 \\\\p' else '\\\\c 1 \\\\v 1 text' end"
    chapters.selectExpr("chapter", f"{text} as value").write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("chapter").text(path)
    sinks.gone_at_end(spark, path)
    return readers.unreadable_usfm(spark, path).select(F.regexp_extract("path", "chapter=([0-9]+)", 1).cast("long").alias("chapter"), "reason")


@query(SQL["verse_detail"], domain=False)
def verse_detail_colocated(spark, sf_dir):
    """verse_detail from two bucketed tables: what joins is where it is met."""
    keys = ["chapter", "verse"]
    verses = sinks.bucketed(adapters.verses(spark, sf_dir).select(*keys, "text"), "verses", keys, 8)
    found = sinks.bucketed(views.index(adapters.reports(spark, sf_dir)), "index", keys, 8)
    return _details(views.detail(verses, found))
