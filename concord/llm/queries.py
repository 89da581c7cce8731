"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import chat, decontam, fixity, gru, hamming, mixing, negatives, phrases, quality, sharding, simhash, syncmers, toxicity
from concord.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 24


def registered(fn):
    QUERIES[fn.__name__] = fn
    return fn


@registered
def op1_simhash(spark, sf):
    docs = table(spark, sf, "documents")
    found = simhash.near_duplicates(docs, width=3, words=1, radius=2, max_bits=2)
    digits = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return found.select(F.col("key").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


@registered
def op2_syncmers(spark, sf):
    found = syncmers.compare_with_next(table(spark, sf, "documents"))
    return found.withColumnRenamed("key", "doc_id")


@registered
def op3_decontamination(spark, sf):
    found = decontam.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "distance", F.col("start").alias("hit_start"), F.col("end").alias("hit_end")
    )


def _held_out(modulus: int):
    return (remainder("doc_id", modulus) == 2).alias("held_out")


@registered
def op4_quality(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    found = quality.classify(docs, model).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", _held_out(4), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


EXTRA_CHAT = "</s>[INST] ok [/INST]"  # fixed value: both turns of conversation -7


@registered
def op5_chat(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, 0, "user", EXTRA_CHAT), (-7, 1, "assistant", EXTRA_CHAT)]
    nodes, routes = chat.format_chats(turns.union(spark.createDataFrame(extra, turns.schema)))
    return chat.read_back(nodes, routes).withColumnRenamed("conv", "conv_id")


def _escaped_sql(column: str) -> str:
    found = f"replace(coalesce({column}, ''), chr(92), chr(92) || chr(92))"
    for control in chat.CONTROLS:
        found = f"replace({found}, '{control}', chr(92) || '{control}')"
    return found


ORACLES["op5_chat"] = f"""WITH turns AS (
 SELECT conv_id, turn, role, text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{EXTRA_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_CHAT}'),
told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {sum(map(len, chat.CONTROLS))} AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(size) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id"""


@registered
def op7_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    found = toxicity.classify(docs, model).withColumnRenamed("key", "doc_id")
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return found.select("doc_id", _held_out(4), "score", predicted, "lang", "threshold", "rejected")


@registered
def op6_sharding(spark, sf):
    placed = sharding.interleave(table(spark, sf, "documents"), SHARDS)
    return placed.select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@registered
def op8_mixing(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select(
        "doc_id",
        "source",
        "lang",
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("tokens"),
        F.round("mix_probability", 6).alias("probability"),
        F.col("mix_kept").alias("kept"),
    )


def _cells_sql() -> str:
    topic = "'prose'"
    for name, cues in reversed(mixing.CUES):
        found = " OR ".join(f"contains(text, '{c}')" for c in cues)
        topic = f"CASE WHEN {found} THEN '{name}' ELSE {topic} END"
    tempers = mixing.Targets().tempers
    goal = ", ".join(f"pow(sum(n) OVER (PARTITION BY {d}) / sum(n) OVER (), {t}) AS g_{d}" for d, t in tempers.items())
    scaled = ", ".join(
        f"g_{d} / (SELECT sum(g) FROM (SELECT DISTINCT {d}, g_{d} AS g FROM goals)) AS t_{d}" for d in tempers
    )
    kept = "source, lang, topic, n, t_source, t_lang, t_topic"
    step = "raked"
    for d in tempers:
        inner = f"SELECT sweep, {kept}, w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM {step}"
        step = f"({inner})" if d != "topic" else inner
    return f"""WITH RECURSIVE told AS (
 SELECT doc_id, source, lang, text IS NULL AS empty,
  CASE WHEN text IS NULL THEN NULL ELSE {topic} END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM told GROUP BY ALL),
goals AS (SELECT *, {goal} FROM cells WHERE n > 0),
targets AS (SELECT *, {scaled} FROM goals),
raked AS (
 SELECT 0 AS sweep, {kept}, n / (SELECT sum(n) FROM targets) AS w FROM targets
 UNION ALL
 SELECT sweep + 1, {kept}, w FROM ({step}) WHERE sweep < {mixing.SWEEPS}),
ratios AS (SELECT source, lang, topic, w / n AS ratio FROM raked WHERE sweep = {mixing.SWEEPS}),
chances AS (SELECT source, lang, topic, ratio / (SELECT max(ratio) FROM ratios) AS p FROM ratios)
SELECT doc_id, t.source, t.lang, t.topic, tokens, round(coalesce(p, 1.0), 6) AS probability,
 ('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / pow(2, 52)
  < coalesce(p, 1.0) AS kept
FROM told t LEFT JOIN chances c ON t.source IS NOT DISTINCT FROM c.source AND t.lang IS NOT DISTINCT FROM c.lang
 AND t.topic IS NOT DISTINCT FROM c.topic"""


ORACLES["op8_mixing"] = _cells_sql()


@registered
def op9_warc_fixity(spark, sf):
    """The second replica has planted faults: changed, cut and lost records."""
    record = fixity.warc_record(F.col("url"), F.col("html"))
    copy = (
        F.when(F.col("page_id") % 101 == 7, F.concat(F.lit("X"), F.substring(record, 2, 2147483647)))
        .when(F.col("page_id") % 103 == 11, F.substring(record, 1, 40))
        .when(F.col("page_id") % 107 == 13, None)
        .otherwise(record)
    )
    both = table(spark, sf, "pages").select("page_id", record.alias("record"), copy.alias("copy"))
    hashed = both.select(
        "page_id",
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"),
        F.octet_length("copy").cast("long").alias("copy_length"),
        F.sha2("copy", 256).alias("copy_digest"),
    )
    laid = fixity.lay_out(hashed, ["page_id", "digest"], "length")
    replica = laid.where(F.col("copy_digest").isNotNull()).select(
        "ordinal", F.col("copy_length").alias("length"), F.col("copy_digest").alias("digest")
    )
    found = fixity.audit(laid.select("ordinal", "length", "digest"), replica)
    spots = found.select("ordinal", "problem", "found_digest")
    return laid.join(spots, "ordinal").select(
        "page_id", "segment", "offset", "length", F.col("digest").alias("expected_digest"), "found_digest", "problem"
    )


ORACLES["op9_warc_fixity"] = f"""WITH records AS (
 SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: '
  || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
 FROM pages),
copies AS (SELECT page_id, record, CASE WHEN page_id % 101 = 7 THEN 'X' || substr(record, 2)
  WHEN page_id % 103 = 11 THEN substr(record, 1, 40) WHEN page_id % 107 = 13 THEN NULL ELSE record END AS copy FROM records),
laid AS (SELECT *, sha256(record) AS digest, octet_length(encode(record)) AS length,
  row_number() OVER (ORDER BY page_id NULLS FIRST, sha256(record)) - 1 AS ordinal FROM copies),
placed AS (SELECT *, ordinal // {fixity.SEGMENT} AS segment,
  CAST(sum(length) OVER (PARTITION BY ordinal // {fixity.SEGMENT} ORDER BY ordinal) - length AS BIGINT) AS "offset" FROM laid)
SELECT page_id, segment, "offset", length, digest AS expected_digest, sha256(copy) AS found_digest,
 CASE WHEN copy IS NULL THEN 'missing' WHEN octet_length(encode(copy)) <> length THEN 'length' ELSE 'changed' END AS problem
FROM placed WHERE copy IS DISTINCT FROM record"""


@registered
def op10_gru(spark, sf):
    docs = table(spark, sf, "documents")
    corpus = gru.gather(docs)
    found = gru.score(docs, corpus, gru.train(docs, corpus)).withColumnRenamed("key", "doc_id")
    return found.select(
        "doc_id", _held_out(7), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@registered
def op11_phrases(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


ORACLES["op11_phrases"] = r"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
told AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM told GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM told, sizes WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS tail
  FROM f, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k),
scored AS (SELECT x.lang, x.phrase, x.a, c, h.a AS l, t.a AS r,
  CAST((CAST(2000000 AS HUGEINT) * x.a) // (CAST(h.a AS HUGEINT) + t.a) AS BIGINT) AS score FROM cuts x
  JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f t ON t.lang = x.lang AND t.phrase = x.tail),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
within AS (SELECT o.lang, array_to_string(o.w[i:i + j - 1], ' ') AS phrase, max(o.a) AS outer_a
  FROM f o, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS j) WHERE j < o.k AND i + j - 1 <= o.k GROUP BY ALL),
left_over AS (SELECT x.* FROM weakest x LEFT JOIN within y ON y.lang = x.lang AND y.phrase = x.phrase
  WHERE y.outer_a IS NULL OR CAST(100 AS HUGEINT) * y.outer_a < CAST(80 AS HUGEINT) * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@registered
def op12_negatives(spark, sf):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


ORACLES["op12_negatives"] = f"""WITH told AS (
 SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor({negatives.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
pairs AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
 FROM told a, told c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
near AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
hard AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
 FROM near JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 10"""


@registered
def op13_neighbours(spark, sf):
    found = hamming.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")
