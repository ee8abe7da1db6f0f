"""Curation and statistics queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import dedup_key
from ..operators import curate, key_index, lid_model, stats
from ..operators.lid import StopWordIdentifier, lid_score
from ..operators.mapping import map_model
from ..session import cut, delete_folder, ensure_checkpoint_dir
from . import fixtures as fx
from .registry import query

_LID = "id, round(source_lid::DOUBLE, 6) AS source_lid, round(target_lid::DOUBLE, 6) AS target_lid"
_FILL = """, scored AS (SELECT id, sid, tid, source_text, target_text, source_nllb_code, target_nllb_code,
 CASE WHEN source_lid IS NULL THEN source_lid_predicted ELSE source_nllb_code END AS source_lid_predicted,
 CASE WHEN target_lid IS NULL THEN target_lid_predicted ELSE target_nllb_code END AS target_lid_predicted,
 coalesce(source_lid, CAST(0.97 AS FLOAT)) AS source_lid, coalesce(target_lid, CAST(0.97 AS FLOAT)) AS target_lid FROM {t})"""
_AGREE = "source_lid_predicted = source_nllb_code AND target_lid_predicted = target_nllb_code"


def _factors(spark, d):
    return curate.correction_factors(fx.sentences(spark, d))


def _scored(df):
    fixed = {s: (F.col(f"{s}_lid_predicted"), F.lit(0.97)) for s in ("source", "target")}
    return curate.lid_resolve(df, fixed)


def _scores(df):
    return df.select("id", *[F.round(F.col(f"{s}_lid").cast("double"), 6).alias(f"{s}_lid") for s in ("source", "target")])


@query(f"WITH {fx.BASE} SELECT code AS nllb_code, sum(length(text))::BIGINT AS total_length, count(text) AS n FROM base GROUP BY code")
def lang_length_totals(spark, d):
    return curate.length_totals(fx.sentences(spark, d))


@query(f"WITH {fx.BASE}{fx.FACTORS} SELECT nllb_code, round(correction_ratio, 9) AS correction_ratio FROM factors")
def correction_factors(spark, d):
    return _factors(spark, d).select("nllb_code", F.round("correction_ratio", 9).alias("correction_ratio"))


@query(f"WITH {fx.FEATURES} SELECT id, sl::BIGINT AS source_length, tl::BIGINT AS target_length, round(sc, 6) AS source_corrected, round(tc, 6) AS target_corrected, round(greatest(sc, tc) / nullif(least(sc, tc), 0), 6) AS length_ratio FROM features")
def length_features(spark, d):
    out = curate.length_features(fx.bitext(spark, d), _factors(spark, d))
    return out.select("id", F.col("source_original_length").cast("long").alias("source_length"), F.col("target_original_length").cast("long").alias("target_length"), F.round("source_corrected_length", 6).alias("source_corrected"), F.round("target_corrected_length", 6).alias("target_corrected"), F.round("length_ratio", 6).alias("length_ratio"))


@query(f"WITH {fx.FEATURES} SELECT id, source_nllb_code, target_nllb_code, source_text, target_text FROM kept")
def length_filter(spark, d):
    return curate.length_filter(fx.bitext(spark, d), _factors(spark, d)).select("id", "source_nllb_code", "target_nllb_code", "source_text", "target_text")


_TURNS = "SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '  ' WHEN turn % 4 = 2 THEN NULL ELSE text END AS text FROM conversations"


def _turns(spark, d):
    own = fx.load(spark, d, "conversations")
    return own.select("conv_id", "turn", F.when(F.col("turn") % 4 == 1, "  ").when(F.col("turn") % 4 == 2, F.lit(None)).otherwise(F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn FROM ({_TURNS}) WHERE length(trim(text)) > 0")
def nonempty_strict(spark, d):
    return curate.non_empty(_turns(spark, d), "text", "text").select("conv_id", "turn")


@query(f"SELECT conv_id, turn FROM ({_TURNS}) WHERE text IS NOT NULL AND length(text) > 0")
def nonempty_notnull(spark, d):
    return curate.non_empty(_turns(spark, d), "text", "text", strict=False).select("conv_id", "turn")


@query(f"WITH {fx.BITEXT}{_FILL.format(t='bitext')} SELECT {_LID}, source_lid_predicted, target_lid_predicted FROM scored")
def lid_resolve(spark, d):
    s = _scored(fx.bitext(spark, d))
    return s.select("id", *[F.round(F.col(f"{x}_lid").cast("double"), 6).alias(f"{x}_lid") for x in ("source", "target")], "source_lid_predicted", "target_lid_predicted")


@query(f"WITH {fx.BITEXT} SELECT {_LID} FROM bitext WHERE {_AGREE}")
def lid_agree(spark, d):
    return _scores(curate.lid_agrees(fx.bitext(spark, d)))


@query(f"WITH {fx.BITEXT} SELECT {_LID} FROM bitext WHERE source_lid > 0.5 AND target_lid > 0.5")
def lid_min_conf(spark, d):
    return _scores(curate.lid_confident(fx.bitext(spark, d)))


_LOW = "CASE WHEN {c} = 'deu_Latn' THEN 'ltz_Latn' ELSE {c} END"


@query(f"""WITH {fx.BITEXT}, low AS (SELECT id, source_lid, target_lid, {_LOW.format(c='source_nllb_code')} AS s, {_LOW.format(c='target_nllb_code')} AS t FROM bitext)
 SELECT {_LID} FROM low WHERE (source_lid > 0.95 OR s = 'ltz_Latn') AND (target_lid > 0.95 OR t = 'ltz_Latn')""")
def lid_high_resource(spark, d):
    low = lambda c: F.when(F.col(c) == "deu_Latn", "ltz_Latn").otherwise(F.col(c))
    return _scores(curate.lid_high_resource(fx.bitext(spark, d).withColumns({c: low(c) for c in ("source_nllb_code", "target_nllb_code")})))


_ALL = f"{_AGREE} AND source_lid > 0.5 AND target_lid > 0.5 AND source_lid > 0.95 AND target_lid > 0.95"


@query(f"WITH {fx.BITEXT}{_FILL.format(t='bitext')} SELECT {_LID} FROM scored WHERE {_ALL}")
def lid_filter_all(spark, d):
    return _scores(curate.lid_filter(_scored(fx.bitext(spark, d))))


@query(f"SELECT doc_id, {fx.KEY.format(c='text')} AS key FROM documents")
def dedup_key_of_documents(spark, d):
    return fx.load(spark, d, "documents").select("doc_id", dedup_key(F.col("text")).alias("key"))


def _first(table: str, side: str, other: str, name: str) -> str:
    return f", {name} AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {fx.KEY.format(c=side + '_text')}, {other}_nllb_code ORDER BY sid, tid) AS rn FROM {table}) WHERE rn = 1)"


_D1, _D2 = _first("kept", "source", "target", "d1"), _first("d1", "target", "source", "d2")
_T = _first("kept", "target", "source", "t1")


def _kept(spark, d):
    return curate.length_filter(fx.bitext(spark, d), _factors(spark, d))


def _dedup(spark, d, direction):
    return curate.dedup(_kept(spark, d), direction, order=("sid", "tid"))


@query(f"WITH {fx.FEATURES}{_D1} SELECT id FROM d1")
def dedup_source(spark, d):
    return _dedup(spark, d, "source").select("id")


@query(f"WITH {fx.FEATURES}{_T} SELECT id FROM t1")
def dedup_target(spark, d):
    return _dedup(spark, d, "target").select("id")


@query(f"WITH {fx.FEATURES}{_D1}{_D2} SELECT id, sid, tid FROM d2")
def dedup_both(spark, d):
    return _dedup(spark, d, "both").select("id", "sid", "tid")


@query("SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role")
def drop_dup_first(spark, d):
    return curate.drop_duplicates_first(fx.load(spark, d, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn")


@query(f"WITH {fx.FEATURES}{_FILL.format(t='kept')}, f AS (SELECT * FROM scored WHERE {_ALL}){_first('f', 'source', 'target', 'd1')}{_D2} SELECT id, source_nllb_code, target_nllb_code, source_text, target_text FROM d2")
def curation_pipeline(spark, d):
    """The flagship: length filter, language identification, two-pass deduplication."""
    kept = curate.lid_filter(_scored(_kept(spark, d)))
    return curate.dedup(kept, "both", order=("sid", "tid")).select("id", "source_nllb_code", "target_nllb_code", "source_text", "target_text")


@query(f"""WITH {fx.FEATURES}{_FILL.format(t='kept')}, f AS (SELECT * FROM scored WHERE {_ALL}), n AS (SELECT 'length' AS stage, (SELECT count(*) FROM bitext) AS rows_in, (SELECT count(*) FROM kept) AS rows_out
 UNION ALL SELECT 'lid', (SELECT count(*) FROM kept), (SELECT count(*) FROM f)) SELECT stage, rows_in, rows_out, round(100.0 * rows_out / rows_in, 2) AS retention, round(100.0 * (rows_in - rows_out) / rows_in, 2) AS reduction FROM n""")
def stage_report(spark, d):
    """What each filter keeps, counted in one pass: filters are flags here, so nothing is scanned twice."""
    factors = _factors(spark, d)
    all_rows = _scored(curate.length_features(fx.bitext(spark, d), factors))
    long = (F.col("source_original_length") >= 15) & (F.col("target_original_length") >= 15) & (F.col("length_ratio") <= 4.0)
    agree = (F.col("source_lid_predicted") == F.col("source_nllb_code")) & (F.col("target_lid_predicted") == F.col("target_nllb_code")) & (F.col("source_lid") > 0.95) & (F.col("target_lid") > 0.95)
    n = all_rows.agg(F.count("*").alias("a"), F.count_if(long).alias("b"), F.count_if(long & agree).alias("c"))
    rows = n.select(F.explode(F.array(F.struct(F.lit("length").alias("stage"), F.col("a").alias("rows_in"), F.col("b").alias("rows_out")), F.struct(F.lit("lid").alias("stage"), F.col("b").alias("rows_in"), F.col("c").alias("rows_out")))).alias("s")).select("s.*")
    return rows.select("*", *curate.report(F.col("rows_in"), F.col("rows_out")))


@query("SELECT (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 16)::INT AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_sizes(spark, d):
    """Rows of each of 16 hash shards."""
    return fx.load(spark, d, "documents").groupBy(curate.shard_of(F.col("doc_id"), 16).alias("shard")).agg(F.count("*").alias("n"))


_QUANTILES = ", ".join(f"quantile_disc(v, {p})::DOUBLE AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75))
_DESCRIBE = f"SELECT nllb_code, count(v) AS count, count(*) FILTER (WHERE v IS NULL) AS null_count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v)::DOUBLE AS min, {_QUANTILES}, max(v)::DOUBLE AS max, count(*) AS total_count FROM s GROUP BY nllb_code"


def _described(df):
    return stats.describe(df).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def _lengths(spark, d):
    return stats.stack_sides(fx.bitext(spark, d), {s: F.char_length(f"{s}_text").cast("double") for s in ("source", "target")})


_STACKED = f"WITH {fx.BITEXT}, s AS (SELECT source_nllb_code AS nllb_code, length(source_text)::DOUBLE AS v FROM bitext UNION ALL SELECT target_nllb_code, length(target_text)::DOUBLE FROM bitext) "


@query(_STACKED + _DESCRIBE)
def describe_length_by_lang(spark, d):
    return _described(_lengths(spark, d))


@query(_STACKED + _DESCRIBE)
def describe_by_rounds(spark, d):
    """The same by rounds of histograms: no task holds a language's lengths."""
    out = stats.describe(_lengths(spark, d), method="rounds")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"WITH {fx.BITEXT}, s AS (SELECT source_nllb_code AS nllb_code, round(source_lid::DOUBLE, 6) AS v FROM bitext UNION ALL SELECT target_nllb_code, round(target_lid::DOUBLE, 6) FROM bitext) {_DESCRIBE}")
def describe_lid_by_lang(spark, d):
    return _described(stats.stack_sides(fx.bitext(spark, d), {s: F.round(F.col(f"{s}_lid").cast("double"), 6) for s in ("source", "target")}))


@query(_STACKED + ", t AS (SELECT nllb_code, count(*) AS total_count FROM s GROUP BY nllb_code) SELECT nllb_code, total_count, (SELECT sum(total_count) FROM t)::BIGINT AS grand_total FROM t ORDER BY total_count")
def total_count_sorted(spark, d):
    from pyspark.sql import Window

    counts = _lengths(spark, d).groupBy("nllb_code").agg(F.count("*").alias("total_count"))
    return counts.withColumn("grand_total", F.sum("total_count").over(Window.partitionBy())).orderBy("total_count", "nllb_code")


_KNOWN = ", ".join(f"'{c}'" for c in stats.LANGUAGES)


@query(f"WITH {fx.BITEXT} SELECT known, count(*) AS n FROM (SELECT source_lid_predicted IN ({_KNOWN}) AS known FROM bitext) GROUP BY known")
def known_unknown_split(spark, d):
    own = fx.bitext(spark, d).select(F.col("source_lid_predicted").alias("nllb_code"))
    part = lambda df, flag: df.agg(F.count("*").alias("n")).select(F.lit(flag).alias("known"), "n")
    return part(stats.known(own), True).unionByName(part(stats.unknown(own), False)).filter("n > 0")


@query(f"WITH {fx.BASE}, l AS (SELECT unnest([{_KNOWN}]) AS nllb_code), c AS (SELECT code, count(*) AS n FROM base GROUP BY code) SELECT nllb_code, coalesce(n, 0)::BIGINT AS total_count FROM l LEFT JOIN c ON code = nllb_code")
def zero_filled_counts(spark, d):
    counts = fx.base(spark, d).groupBy(F.col("code").alias("nllb_code")).agg(F.count("*").alias("total_count"))
    return stats.zero_filled(counts).select("nllb_code", F.col("total_count").cast("long").alias("total_count"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang ORDER BY n DESC")
def group_sizes(spark, d):
    return fx.load(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT conv_id, array_to_string(list_sort(list(role)), ',') AS roles FROM conversations GROUP BY conv_id")
def group_lists(spark, d):
    return fx.load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("role")), ",").alias("roles"))


@query("SELECT DISTINCT source, lang FROM documents")
def distinct_values(spark, d):
    return fx.load(spark, d, "documents").select("source", "lang").distinct()


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def tumbling_stats(spark, d):
    """The streaming extension's aggregation over a batch."""
    from ..streaming.curation import tumbling_stats as tumbling

    return tumbling(fx.load(spark, d, "events"), "ts", "value", "event_type").withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "mean": F.round("mean", 6)})


_WORDS = ", ".join(f"list_sum(list_transform(ws, lambda w : list_contains({sorted(v.split())!r}, w)::INT)) AS s{i}" for i, v in enumerate(StopWordIdentifier.WORDS.values()))
_RULE = """(SELECT doc_id, (CASE WHEN s0 + s1 + s2 + s3 > 0 THEN greatest(s0, s1, s2, s3) / (s0 + s1 + s2 + s3) ELSE 0 END)::FLOAT AS score
 FROM (SELECT doc_id, """ + _WORDS + r""" FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents)))"""


@query(f"""WITH {fx.BITEXT}, r AS {_RULE} SELECT id, round(coalesce(source_lid, coalesce(a.score, 0))::DOUBLE, 6) AS source_lid, round(coalesce(target_lid, coalesce(b.score, 0))::DOUBLE, 6) AS target_lid
 FROM bitext JOIN r a ON a.doc_id = sid JOIN r b ON b.doc_id = tid""")
def lid_rule_scores(spark, d):
    """The rule-based language identifier over both sides of the bitext, where they have no score."""
    own = fx.bitext(spark, d).drop("source_lid_predicted", "target_lid_predicted")
    return _scores(lid_score(own))


def _ngrams(order: int) -> str:
    """Buckets of a text's n-grams from its code points plus one, cp."""
    sums = " + ".join(f"cp[i + {k}] * {m}" for k, m in enumerate(lid_model.MULTIPLIERS[:order]))
    return f"list_transform(range(1, len(cp) - {order} + 2), lambda i : ((({order} + {sums}) % 4294967296) * {lid_model.MIX} % 4294967296) >> {32 - lid_model.BITS})"


_BUCKETS = f"""p AS (SELECT doc_id, lang, list_transform(regexp_extract_all(lower(coalesce(text, '')), '(?s).'), lambda c : unicode(c)::BIGINT + 1) AS cp FROM documents),
 g AS (SELECT doc_id, lang, unnest(list_concat({", ".join(_ngrams(n) for n in lid_model.ORDERS)})) AS b FROM p),
 c AS (SELECT lang AS label, b AS bucket, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY lang, b)"""


@query(f"WITH {_BUCKETS} SELECT label, bucket, n FROM c")
def lid_ngram_counts(spark, d):
    """What the n-gram model is made of."""
    return lid_model.bucket_counts(fx.load(spark, d, "documents"))


_MODEL = f"""WITH {_BUCKETS}, t AS (SELECT label, sum(n) AS total FROM c GROUP BY label), k AS (SELECT doc_id, b, count(*) AS k FROM g GROUP BY doc_id, b),
 s AS (SELECT doc_id, t.label, sum(k * ln((coalesce(n, 0) + 0.5) / (total + 0.5 * {1 << lid_model.BITS}))) AS s FROM k CROSS JOIN t LEFT JOIN c ON c.label = t.label AND c.bucket = b GROUP BY doc_id, t.label),
 m AS (SELECT doc_id, max(s) AS m FROM s GROUP BY doc_id), o AS (SELECT doc_id, min(label) FILTER (WHERE s = m) AS label, round(1 / sum(exp((s - m) / {len(lid_model.ORDERS)})), 6) AS score FROM s JOIN m USING (doc_id) GROUP BY doc_id)
 SELECT documents.doc_id, coalesce(o.label, 'unknown') AS {{label}}, coalesce(o.score, 0) AS {{score}} FROM documents LEFT JOIN o ON o.doc_id = documents.doc_id"""


@query(_MODEL.format(label='label', score='score'))
def lid_model_scores(spark, d):
    """A model of the documents' languages, and what it says of each document."""
    docs = fx.load(spark, d, "documents")
    out = lid_model.identify_by(docs.select("doc_id", "text"), ["text"], lid_model.NgramModel.train(docs))
    return out.select("doc_id", F.col("text_label").alias("label"), F.round("text_score", 6).alias("score"))


@query(_MODEL.format(label="predicted_label", score="confidence_score"))
def model_classify(spark, d):
    """The same model as a mapped model task: a worker process makes it once, and it gets texts a few at a time."""
    docs = fx.load(spark, d, "documents")
    model = lid_model.NgramModel.train(docs)
    out = map_model(docs.select("doc_id", "text"), "classification", lambda: lid_model.Classifier(model), rows=64)
    return out.select("doc_id", "predicted_label", F.round("confidence_score", 6).alias("confidence_score"))


@query(f"WITH {fx.FEATURES}{_D1}{_D2} SELECT id, sid, tid FROM d2")
def dedup_increments(spark, d):
    """The pairs in three batches, each against the index of the keys before it: the rows of one run over all."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/keys-{uuid.uuid4().hex}"
    # three batches read the pairs six times: they are made once
    kept = cut(_kept(spark, d).select("id", "sid", "tid", *[f"{s}_{c}" for s in ("source", "target") for c in ("text", "nllb_code")]))
    last = kept.agg(F.max("sid").alias("n")).first().n or 0
    out, low = None, None
    for k, high in enumerate((last // 2, last // 2 + last // 4, last)):
        own = F.col("sid") <= high
        batch = kept.filter(own if low is None else own & (F.col("sid") > low))
        new = cut(key_index.dedup_batch(batch, folder, f"batch-{k}", order=("sid", "tid"), buckets=8).select("id", "sid", "tid"))
        out, low = new if out is None else out.union(new), high
    delete_folder(spark, folder)
    return out
