"""Batching and token-sequence queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import sequences as s
from ..operators import batching as b
from ..operators import noise
from ..operators.mapping import buffer_shuffled, map_model
from ..operators.ordering import number_rows
from ..operators.permute import Permutation, numbered, permuted
from ..session import ship_package
from . import fixtures as fx
from .registry import query

BOUNDS = [200, 500, 1000, 2000, 4000]
_CAPS = b.caps(BOUNDS, 8000, 16)
_LONGEST = 1024  # tokens of an encoded sequence or a padded row: the operators' own limit


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"WITH {fx.TOKENS} SELECT id, array_to_string(list_concat(list_concat([id % 4 + 5], ids[1:{_LONGEST - 2}]), [2]), ',') AS ids FROM tokens")
def encode_sequence(spark, d):
    own = fx.tokens(spark, d)
    return own.select("id", _text(s.encode(F.col("ids"), (F.col("id") % 4 + 5).cast("int"), 2, _LONGEST)).alias("ids"))


def _numbered(spark, d):
    return fx.load(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length"))


@query("SELECT doc_id, doc_id // 64 AS buffer, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def buffer_sort(spark, d):
    out = b.buffer_sort(_numbered(spark, d), "doc_id", 64, F.col("length"))
    return out.select("doc_id", F.col("buffer").cast("long").alias("buffer"), F.col("rank").cast("long").alias("rank"))


_BUCKET = f"len(list_filter({BOUNDS}, lambda x : x < n_chars))"


@query(f"SELECT doc_id, {_BUCKET}::BIGINT AS bucket FROM documents")
def bucket_assign(spark, d):
    return _numbered(spark, d).select("doc_id", s.bucket(F.col("length"), BOUNDS).cast("long").alias("bucket"))


_BATCHES = f"""WITH k AS (SELECT doc_id, n_chars, {_BUCKET} AS bucket FROM documents), c AS (SELECT *, ({_CAPS})[bucket + 1] AS cap FROM k),
 batches AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1) // cap AS batch FROM c)"""


def _batches(spark, d):
    return b.dynamic_batches(_numbered(spark, d), BOUNDS, 8000, order="doc_id", max_examples=16)


@query(_BATCHES + " SELECT doc_id, bucket::BIGINT AS bucket, batch::BIGINT AS batch FROM batches")
def dynamic_batches(spark, d):
    return _batches(spark, d).select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.col("batch").cast("long").alias("batch"))


@query(_BATCHES + " SELECT bucket::BIGINT AS bucket, count(*) AS n, min(n_chars) AS min_len, max(n_chars) AS max_len, sum(n_chars)::BIGINT AS total, round((max(n_chars) - min(n_chars)) / nullif(avg(n_chars), 0), 6) AS pad_factor, (count(*) // max(cap))::BIGINT AS num_batches FROM batches GROUP BY bucket")
def bucket_stats(spark, d):
    return b.bucket_stats(_batches(spark, d)).withColumn("bucket", F.col("bucket").cast("long"))


@query(_BATCHES + " SELECT bucket::BIGINT AS bucket, batch::BIGINT AS batch, sum(n_chars)::BIGINT AS total, (max(n_chars) * count(*) - sum(n_chars))::BIGINT AS padding, round(100.0 * (max(n_chars) * count(*) - sum(n_chars)) / nullif(max(n_chars) * count(*), 0), 6) AS padding_pct FROM batches GROUP BY bucket, batch")
def batch_padding(spark, d):
    out = b.batch_padding(_batches(spark, d))
    return out.withColumns({"bucket": F.col("bucket").cast("long"), "batch": F.col("batch").cast("long")})


_ORDER = _BATCHES + ", o AS (SELECT bucket, batch, max(n_chars) AS max_len FROM batches GROUP BY bucket, batch), p AS (SELECT *, row_number() OVER (ORDER BY max_len DESC, bucket, batch) - 1 AS position FROM o)"


def _order(spark, d):
    return b.batch_order(_batches(spark, d), "descending").select(F.col("bucket").cast("long").alias("bucket"), F.col("batch").cast("long").alias("batch"), "max_len", F.col("position").cast("long").alias("position"))


@query(_ORDER + " SELECT bucket::BIGINT AS bucket, batch::BIGINT AS batch, max_len, position FROM p")
def batch_order_desc(spark, d):
    return _order(spark, d)


@query(_ORDER + ", n AS (SELECT count(*) AS n FROM p), w AS (SELECT position AS slot, position FROM p UNION ALL SELECT position + n, position FROM p, n WHERE position + n < ceil(n / 4.0) * 4) SELECT slot::BIGINT AS slot, position FROM w WHERE slot % 4 = 1")
def rank_shard(spark, d):
    return b.rank_shard(_order(spark, d), "position", 4, 1).select("slot", "position")


@query(f"""WITH {fx.TOKENS}, t AS (SELECT id, id // 8 AS batch, ids AS x FROM tokens), m AS (SELECT *, least(max(len(x)) OVER (PARTITION BY batch), {_LONGEST}) AS top FROM t)
 SELECT id, array_to_string(list_transform(range(1, top + 1), lambda k : coalesce(x[k], 1)), ',') AS ids, array_to_string(list_transform(range(1, top + 1), lambda k : CASE WHEN k <= len(x) THEN 1 ELSE 0 END), ',') AS mask FROM m""")
def pad_and_mask(spark, d):
    own = fx.tokens(spark, d).select("id", F.floor(F.col("id") / 8).alias("batch"), F.col("ids").alias("x"))
    return b.pad_batch(own, {"x": 1}, ["batch"], _LONGEST).select("id", _text("x").alias("ids"), _text("x_mask").alias("mask"))


@query(f"""WITH {fx.TOKENS}, p AS (SELECT id, ids AS s, list_reverse(ids) AS t, id % 3 = 0 AS dae FROM tokens)
 SELECT id, 0 AS side, array_to_string(s, ',') AS input_ids, array_to_string(CASE WHEN dae THEN s ELSE t END, ',') AS labels, CASE WHEN dae THEN 0 ELSE 1 END AS mse FROM p
 UNION ALL SELECT id, 1, array_to_string(t, ','), array_to_string(CASE WHEN dae THEN t ELSE s END, ','), CASE WHEN dae THEN 0 ELSE 1 END FROM p""")
def expand_pairs(spark, d):
    own = fx.tokens(spark, d).select("id", F.col("ids").alias("source_ids"), F.reverse("ids").alias("target_ids"))
    out = b.expand_pairs(own, F.col("id") % 3 == 0)
    return out.select("id", "side", _text("input_ids").alias("input_ids"), _text("labels").alias("labels"), "mse")


@query(f"""WITH {fx.TOKENS}, p AS (SELECT id, ids AS s, list_reverse(ids) AS t, id % 3 AS k FROM tokens)
 SELECT id, 0 AS side, array_to_string(s, ',') AS input_ids, array_to_string(CASE WHEN k = 0 THEN s ELSE t END, ',') AS labels, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 END AS mse FROM p
 UNION ALL SELECT id, 1, array_to_string(t, ','), array_to_string(CASE WHEN k = 0 THEN t ELSE s END, ','), k FROM p WHERE k < 2""")
def expand_with_evaluation(spark, d):
    own = fx.tokens(spark, d).select("id", F.col("ids").alias("source_ids"), F.reverse("ids").alias("target_ids"))
    out = b.expand_pairs(own, F.col("id") % 3 == 0, whole=F.col("id") % 3 == 2)
    return out.select("id", "side", _text("input_ids").alias("input_ids"), _text("labels").alias("labels"), "mse")


_FIRST = {4: "eng_Latn", 5: "fra_Latn", 6: "deu_Latn"}


@query(f"WITH {fx.TOKENS} SELECT id, CASE id % 4 + 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _FIRST.items()) + " END AS code FROM tokens")
def language_of_first_token(spark, d):
    """The fourth token has no language."""
    encoded = s.encode(F.col("ids"), (F.col("id") % 4 + 4).cast("int"), 2, _LONGEST)
    return fx.tokens(spark, d).select("id", s.code_of_first(encoded, _FIRST).alias("code"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, true AS moved, true AS within FROM documents")
def buffer_shuffle_moves(spark, d):
    """What a buffer of 50 rows does to the order: nine rows in ten move, and none comes out more than a buffer before its place."""
    at, out = F.monotonically_increasing_id(), F.col("after")
    rows = buffer_shuffled(fx.load(spark, d, "documents").select("doc_id").withColumn("before", at), 50).withColumn("after", at)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"), (F.avg((out != F.col("before")).cast("double")) > 0.9).alias("moved"), (F.max(F.col("before") - out) <= 50).alias("within"))


@query("SELECT doc_id, text FROM documents")
def buffer_shuffle(spark, d):
    """Every row comes out once, whatever the order."""
    return buffer_shuffled(fx.load(spark, d, "documents").select("doc_id", "text"), 1000)


class _ByLength:
    """Stands in for a classifier: a text's label and score follow from its length."""

    def run(self, texts):
        return [("long" if len(t) > 500 else "short", len(t) / (len(t) + 500)) for t in texts]


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END AS predicted_label, round(length(text) / (length(text) + 500.0)::DOUBLE, 6) AS confidence_score FROM documents")
def model_map(spark, d):
    own = map_model(fx.load(spark, d, "documents").select("doc_id", "text"), "classification", _ByLength)
    return own.select("doc_id", "predicted_label", F.round("confidence_score", 6).alias("confidence_score"))


@query(f"""WITH {fx.TOKENS}, n AS (SELECT id, ids, len(ids) - 2 AS n, CASE WHEN len(ids) > 2 THEN (id * 7) % (len(ids) - 2) ELSE 0 END AS k FROM tokens)
 SELECT id, array_to_string(CASE WHEN n < 2 THEN ids ELSE list_concat(list_concat(ids[1:1], list_concat(ids[k + 2:n + 1], ids[2:k + 1])), ids[n + 2:n + 2]) END, ',') AS ids FROM n""")
def rotate_tokens(spark, d):
    return fx.tokens(spark, d).select("id", _text(s.rotate(F.col("ids"), F.col("id") * 7)).alias("ids"))


@query(f"WITH {fx.TOKENS} SELECT id, array_to_string(list_transform(ids, lambda x : CASE WHEN x = 13 THEN 0 ELSE x END), ',') AS ids FROM tokens")
def strip_ignore_index(spark, d):
    marked = F.transform("ids", lambda x: F.when(x == 13, -100).otherwise(x))
    return fx.tokens(spark, d).select("id", _text(s.replace_ignored(marked, 0)).alias("ids"))


#: The training ratios, with a sentence ending in each word of three characters, so that there are sentences to move.
_NOISE = replace(noise.TRAINING, stop_id=13)


def _masked(table: str, place: str) -> str:
    """Tokens of a table (id, place, t, n) with the share of the body masked whose draws are the least."""
    inside = f"{place} BETWEEN 1 AND n - 2"
    rank = f"row_number() OVER (PARTITION BY id, {inside} ORDER BY {noise.draw_sql('id', noise.MASK, place)}, {place})"
    return f"SELECT id, {place} AS place, n, CASE WHEN {inside} AND {rank} <= ceil({_NOISE.mask}::DOUBLE * greatest(0, n - 2)) THEN {_NOISE.mask_id} ELSE t END AS t FROM {table}"


_NOISED = f"""WITH {fx.TOKENS}, k AS (SELECT id, unnest(ids)::BIGINT AS t, unnest(range(len(ids)))::BIGINT AS i, len(ids)::BIGINT AS n FROM tokens),
 a AS (SELECT *, CASE WHEN i BETWEEN 1 AND n - 2 THEN count(*) FILTER (WHERE t = {_NOISE.stop_id} AND i BETWEEN 1 AND n - 2) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS part FROM k),
 p AS (SELECT id, part, count(*) OVER (PARTITION BY id) AS m, row_number() OVER (PARTITION BY id ORDER BY {noise.draw_sql('id', noise.PERMUTE, 'part')}, part) AS r FROM (SELECT DISTINCT id, part FROM a WHERE part IS NOT NULL)),
 c AS (SELECT id, part, r, row_number() OVER (PARTITION BY id ORDER BY part) AS s FROM p WHERE m > 1 AND r <= ceil({_NOISE.permute}::DOUBLE * m)),
 slots AS (SELECT p.id, p.part, coalesce(y.part, p.part) AS slot FROM p LEFT JOIN c x ON x.id = p.id AND x.part = p.part LEFT JOIN c y ON y.id = x.id AND y.s = x.r),
 moved AS (SELECT a.id, t, n, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN i = 0 THEN -1 ELSE coalesce(slot, 1000000) END, i) - 1 AS place FROM a LEFT JOIN slots ON slots.id = a.id AND slots.part = a.part),
 hidden AS ({_masked('moved', 'place')}), plain AS ({_masked('k', 'i')}),
 more AS (SELECT id, 1 + {noise.draw_sql('id', noise.INSERT, 'j')} % (n - 1) AS place FROM (SELECT id, len(ids)::BIGINT AS n, unnest(range(ceil({_NOISE.insert}::DOUBLE * len(ids))::BIGINT)) AS j FROM tokens WHERE len(ids) > 2)),
 every AS (SELECT id, place, 1 AS own, t FROM hidden UNION ALL SELECT id, place, 0, {_NOISE.mask_id} FROM more),
 noised AS (SELECT id, string_agg(t::VARCHAR, ',' ORDER BY place, own) AS noised FROM every GROUP BY id)"""


@query(f"{_NOISED} SELECT id, noised, masked FROM noised JOIN (SELECT id, string_agg(t::VARCHAR, ',' ORDER BY place) AS masked FROM plain GROUP BY id) USING (id)")
def noise_compose(spark, d):
    """Denoising noise on every document's tokens: all steps with the training ratios, and masks alone."""
    ship_package(spark)
    own = fx.tokens(spark, d)
    alone = noise.Noise(mask=_NOISE.mask, random=0.0, rotate=0.0)
    return own.select("id", _text(noise.noised(F.col("ids"), F.col("id"), _NOISE)).alias("noised"), _text(noise.noised(F.col("ids"), F.col("id"), alone)).alias("masked"))


@query(f"{_NOISED} SELECT id, side, CASE WHEN id % 2 = 0 THEN array_to_string(ids, ',') ELSE noised END AS input_ids, array_to_string(ids, ',') AS labels FROM tokens JOIN noised USING (id), (VALUES (0), (1)) s(side)")
def noisy_pairs(spark, d):
    """Pair expansion with composed noise: sides of odd documents are rebuilt from their noise, even ones go as they are."""
    ship_package(spark)
    own = fx.tokens(spark, d).select("id", F.col("ids").alias("source_ids"), F.col("ids").alias("target_ids"))
    out = b.expand_pairs(own, F.col("id") % 2 != 0, noise=lambda c: noise.noised(c, F.col("id"), _NOISE))
    return out.select("id", "side", _text(F.col("input_ids")).alias("input_ids"), _text(F.col("labels")).alias("labels"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def first_n(spark, d):
    """The feature itself: the first rows by position."""
    return fx.load(spark, d, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(100)


@query("SELECT event_id, value * 16000 AS length FROM events WHERE value * 16000 > 16000 AND value * 16000 < 320000")
def audio_length_range(spark, d):
    own = fx.load(spark, d, "events").select("event_id", (F.col("value") * 16000).alias("length"))
    return b.length_between(own, "length", 1.0, 20.0)


@query("SELECT lang, doc_id, n_chars FROM documents ORDER BY n_chars DESC, lang DESC, doc_id DESC")
def multi_key_sort(spark, d):
    return fx.load(spark, d, "documents").select("lang", "doc_id", "n_chars").orderBy(F.desc("n_chars"), F.desc("lang"), F.desc("doc_id"))


@query("SELECT i, d.doc_id, d.n_chars FROM (SELECT doc_id AS i, (doc_id * 3) % (SELECT count(*) FROM documents) AS doc_id FROM documents) JOIN documents d USING (doc_id)")
def gather_positions(spark, d):
    own = fx.load(spark, d, "documents")
    wanted = own.select(F.col("doc_id").alias("i"), (F.col("doc_id") * 3 % F.lit(own.count())).alias("doc_id"))
    return b.gather(own.select("doc_id", "n_chars"), wanted, "doc_id").select("i", "doc_id", "n_chars")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal FROM documents")
def global_ordinal(spark, d):
    own = fx.load(spark, d, "documents").select("doc_id", "source")
    return number_rows(own, ["source", "doc_id"], "ordinal").select("doc_id", "ordinal")


#: Rows by doc_id with the sides of their grid; five walks are more than these tables take.
_PLACES = "WITH n AS (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id)::BIGINT - 1 AS row, n, a, (n + a - 1) // a AS b FROM documents, n)"


def _walks(epoch: int) -> str:
    walk = Permutation(1, 42, epoch).sql
    ctes = [f"w{epoch}0 AS (SELECT doc_id, n, a, b, {walk('row')} AS p FROM r)"]
    ctes += [f"w{epoch}{k} AS (SELECT doc_id, n, a, b, CASE WHEN p < n THEN p ELSE {walk('p')} END AS p FROM w{epoch}{k - 1})" for k in range(1, 5)]
    return ", ".join(ctes)


@query(f"{_PLACES}, {_walks(0)}, {_walks(1)} SELECT doc_id, x.p AS first_epoch, y.p AS second_epoch FROM w04 x JOIN w14 y USING (doc_id)")
def permute_epochs(spark, d):
    """Each document's place in two epochs of a shuffle of the whole table."""
    rows, n = numbered(fx.load(spark, d, "documents").select("doc_id"), ["doc_id"])
    out = permuted(rows, n, name="first_epoch")
    return permuted(out, n, epoch=1, name="second_epoch").select("doc_id", "first_epoch", "second_epoch")
