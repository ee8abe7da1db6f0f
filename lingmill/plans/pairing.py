"""Ingestion and pairing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as reg
from ..functions.text import canonical_pair as canonical
from ..operators import pairing
from ..sources import readers
from . import fixtures as fx
from .registry import query


@query(f"""WITH {fx.BITEXT}, raw AS (SELECT sid, tid, source_text, target_text, source_lid, sid % 3 AS m FROM bitext WHERE source_nllb_code = 'eng_Latn' AND target_nllb_code = 'fra_Latn'),
 n AS (SELECT *, row_number() OVER (ORDER BY sid, tid) - 1 AS k FROM raw)
 SELECT 'allenai_eng_Latn-fra_Latn_' || k AS id, 'eng_Latn' AS source_nllb_code, 'fra_Latn' AS target_nllb_code, trim(source_text, e' \\n\\t') AS source_text, trim(CASE WHEN m = 0 THEN '  ' ELSE target_text END, e' \\n\\t') AS target_text,
 round(source_lid::DOUBLE, 6) AS source_lid, NULL::DOUBLE AS target_lid, '' AS source_url, 'allenai' AS dataset FROM n WHERE m <> 0""")
def mined_transform(spark, d):
    own = fx.bitext(spark, d).filter("source_nllb_code = 'eng_Latn' and target_nllb_code = 'fra_Latn'")
    blank = F.when(F.col("sid") % 3 == 0, "  ").otherwise(F.col("target_text"))
    raw = own.select("sid", "tid", F.struct(F.col("source_text").alias("en"), blank.alias("fr")).alias("translation"), F.col("source_lid").alias("source_sentence_lid"))
    out = pairing.mined_transform(raw, ("en", "eng_Latn"), ("fr", "fra_Latn"), order=["sid", "tid"])
    return out.select("id", "source_nllb_code", "target_nllb_code", "source_text", "target_text", *[F.round(F.col(f"{s}_lid").cast("double"), 6).alias(f"{s}_lid") for s in ("source", "target")], "source_url", "dataset")


@query(f"""WITH {fx.SEED}, many AS (SELECT nllb_code FROM seed GROUP BY nllb_code HAVING count(*) > 110), s AS (SELECT * FROM seed WHERE nllb_code IN (SELECT nllb_code FROM many))
 SELECT 'seed.' || a.nllb_code || '-' || b.nllb_code || '.' || a.id AS id, a.nllb_code AS source_nllb_code, b.nllb_code AS target_nllb_code, a.url AS source_url, b.url AS target_url FROM s a JOIN s b ON a.id = b.id AND a.nllb_code < b.nllb_code WHERE length(a.text) > 0 AND length(b.text) > 0""")
def seed_pairs(spark, d):
    return pairing.seed_pairs(fx.seed(spark, d), min_samples=110).select("id", "source_nllb_code", "target_nllb_code", "source_url", "target_url")


@query(f"""WITH {fx.SENTENCES}, p AS (SELECT a.source, a.id, a.nllb_code AS source_nllb_code, b.nllb_code AS target_nllb_code, a.sentence AS source_text, b.sentence AS target_text FROM sentences a JOIN sentences b ON a.source = b.source AND a.id = b.id
 WHERE a.nllb_code = 'eng_Latn' OR b.nllb_code = 'eng_Latn' OR a.nllb_code = b.nllb_code)
 SELECT source, id, source_nllb_code, target_nllb_code FROM (SELECT *, row_number() OVER (PARTITION BY source_nllb_code, target_nllb_code, source_text, target_text ORDER BY source, id) AS rn FROM p) WHERE rn = 1""")
def flores_pairs(spark, d):
    out = pairing.flores_pairs(fx.sentences(spark, d), by=["source", "id"])
    return out.select("source", "id", "source_nllb_code", "target_nllb_code")


@query("SELECT item_id, -row_number() OVER (ORDER BY item_id) AS id FROM benchmark")
def hard_negative_ids(spark, d):
    return pairing.hard_negative_ids(fx.load(spark, d, "benchmark"), ["item_id"]).select("item_id", "id")


@query(f"""WITH {fx.SEED}, l AS (SELECT unnest(['ace_Arab', 'eng_Latn', 'fra_Latn', 'zul_Latn', 'wol_Latn']) AS code)
 SELECT s.id, s.nllb_code AS source_nllb_code, code AS target_nllb_code, length(s.text)::BIGINT AS length FROM seed s, l WHERE s.nllb_code = 'eng_Latn' AND code NOT IN (SELECT nllb_code FROM seed)""")
def backtranslate_worklist(spark, d):
    langs = spark.createDataFrame([(c,) for c in ("ace_Arab", "eng_Latn", "fra_Latn", "zul_Latn", "wol_Latn")], "nllb_code string")
    return pairing.backtranslation_worklist(fx.seed(spark, d), langs).select("id", "source_nllb_code", "target_nllb_code", F.col("length").cast("long").alias("length"))


@query("SELECT a.conv_id, a.turn, a.text AS source_text, b.text AS target_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'")
def conversation_pairs(spark, d):
    return pairing.next_row_pairs(fx.load(spark, d, "conversations"), "conv_id", "turn", "text", F.col("role") == "user")


_SONG = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id || '  b  c|x  y' || doc_id || '   z' ELSE 'a  b' || doc_id || '|x' END AS v FROM documents"


@query(f"""WITH s AS ({_SONG}), p AS (SELECT doc_id, string_split_regex(split_part(v, '|', 1), '\\s\\s+') AS a, string_split_regex(split_part(v, '|', 2), '\\s\\s+') AS b FROM s)
 SELECT doc_id, unnest(CASE WHEN len(a) = len(b) THEN a ELSE [array_to_string(a, ' ')] END) AS source_text, unnest(CASE WHEN len(a) = len(b) THEN b ELSE [array_to_string(b, ' ')] END) AS target_text FROM p""")
def lyrics_explode(spark, d):
    i = F.col("doc_id").cast("string")
    v = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a"), i, F.lit("  b  c|x  y"), i, F.lit("   z"))).otherwise(F.concat(F.lit("a  b"), i, F.lit("|x")))
    return fx.load(spark, d, "documents").select("doc_id", F.explode(readers.bar_lines(v)).alias("p")).select("doc_id", "p.*")


@query("SELECT event_id, event_type AS before, props || chr(9) || 'end' AS after FROM events")
def tab_split(spark, d):
    line = F.concat_ws("\t", "event_type", "props", F.lit("end"))
    before, after = readers.tab_split(line)
    return fx.load(spark, d, "events").select("event_id", before.alias("before"), after.alias("after"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' ELSE lang END AS code FROM documents")
def code_remap(spark, d):
    return fx.load(spark, d, "documents").select("doc_id", reg.remap(F.col("lang"), {"en": "eng_Latn", "fr": "fra_Latn"}).alias("code"))


@query(f"WITH {fx.BITEXT} SELECT id, least(source_nllb_code, target_nllb_code) || '-' || greatest(source_nllb_code, target_nllb_code) AS pair, lower(target_nllb_code || '-' || source_nllb_code) AS folder FROM bitext")
def canonical_pair(spark, d):
    from ..functions.text import lower_pair

    s, t = F.col("source_nllb_code"), F.col("target_nllb_code")
    return fx.bitext(spark, d).select("id", canonical(t, s).alias("pair"), lower_pair(t, s).alias("folder"))


@query("SELECT split_part(p, '-', 1) AS source, split_part(p, '-', 2) AS target FROM (SELECT unnest(string_split('eng_Latn-fra_Latn,deu_Latn-eng_Latn,ace_Arab-zul_Latn', ',')) AS p)")
def pair_list_parse(spark, d):
    return spark.createDataFrame(reg.parse_pairs("eng_Latn-fra_Latn, deu_Latn-eng_Latn,ace_Arab-zul_Latn"), "source string, target string")


@query("SELECT DISTINCT a.lang AS source, b.lang AS target FROM documents a, documents b WHERE a.lang < b.lang")
def all_combinations(spark, d):
    return reg.all_pairs(fx.load(spark, d, "documents"), "lang")


_WIDE = "SELECT source, max(CASE WHEN lang = 'en' THEN doc_id END)::VARCHAR AS en, max(CASE WHEN lang = 'fr' THEN doc_id END)::VARCHAR AS fr, max(CASE WHEN lang = 'de' THEN doc_id END)::VARCHAR AS de FROM documents GROUP BY source"


@query(f"WITH w AS ({_WIDE}) SELECT source, 'en' AS source_lang, en AS source_text, 'fr' AS target_lang, fr AS target_text FROM w UNION ALL SELECT source, 'en', en, 'de', de FROM w")
def multilingual_unpivot(spark, d):
    wide = fx.load(spark, d, "documents").groupBy("source").agg(*[F.max(F.when(F.col("lang") == x, F.col("doc_id"))).cast("string").alias(x) for x in ("en", "fr", "de")])
    return readers.unpivot_pairs(wide, ["en", "fr", "de"], "source", "en")


@query("SELECT lang FROM (SELECT DISTINCT lang FROM documents) WHERE lang NOT IN ('en', 'fr')")
def missing_languages(spark, d):
    have = spark.createDataFrame([("en",), ("fr",)], "lang string")
    return fx.load(spark, d, "documents").select("lang").subtract(have)


@query("SELECT doc_id, CASE WHEN c = 'sat_Olck' THEN 'sat_Beng' ELSE c END AS code FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'sat_Olck' WHEN 1 THEN 'eng_Latn' ELSE 'xx_Xxxx' END AS c FROM documents) WHERE c <> 'xx_Xxxx'")
def alias_and_skip(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, "sat_Olck").when(F.col("doc_id") % 3 == 1, "eng_Latn").otherwise("xx_Xxxx")
    return fx.load(spark, d, "documents").select("doc_id", reg.remap(raw, reg.ALIASES).alias("code")).filter(reg.is_known(F.col("code")))


@query("SELECT conv_id, turn, regexp_replace(role || chr(10) || text, '\\n', ' ', 'g') AS line FROM conversations")
def newline_to_space(spark, d):
    from ..functions.text import one_line

    return fx.load(spark, d, "conversations").select("conv_id", "turn", one_line(F.concat("role", F.lit("\n"), "text")).alias("line"))


@query("SELECT doc_id, regexp_replace('__label__' || lang, '^__label__', '') AS label, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' END || '_' || 'Latn' AS code FROM documents")
def label_and_code(spark, d):
    from ..functions import text as t

    iso = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fra")
    return fx.load(spark, d, "documents").select("doc_id", t.label(F.concat(F.lit("__label__"), "lang")).alias("label"), t.code(iso, F.lit("Latn")).alias("code"))


@query("SELECT doc_id, 'a' || doc_id AS source_text, CASE WHEN doc_id % 2 = 0 THEN 'b' || doc_id END AS target_text FROM documents")
def tmx_units(spark, d):
    i = F.col("doc_id").cast("string")
    part = lambda lang, text: F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), F.lit(text), i, F.lit("</seg></tuv>"))
    unit = F.concat(F.lit("<tu>"), part("en", "a"), F.when(F.col("doc_id") % 2 == 0, part("fr", "b")).otherwise(""), F.lit("</tu>"))
    source, target = readers.tmx_unit(unit, "en", "fr")
    return fx.load(spark, d, "documents").select("doc_id", source.alias("source_text"), target.alias("target_text"))


@query("SELECT event_id AS line, event_type AS source_text, props AS target_text FROM events")
def line_pairs(spark, d):
    """Two line streams beside each other by line number."""
    own = fx.load(spark, d, "events")
    return pairing.aligned(own.select(F.col("event_id").alias("line"), "event_type"), own.select(F.col("event_id").alias("line"), "props"), "event_type", "props")


@query("SELECT doc_id, 'x' || doc_id || ' y' AS source_text, 'z' || doc_id AS target_text FROM documents UNION ALL SELECT doc_id, 'last', 'one' FROM documents")
def marked_block_pairs(spark, d):
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("gn: x"), i, F.lit("\ny\nes: z"), i, F.lit("\ngn: last\nes: one"))
    return fx.load(spark, d, "documents").select("doc_id", F.explode(readers.marked_blocks(text, "gn", "es")).alias("p")).select("doc_id", "p.*")
