"""The registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, prepare, read
from .oracle import ORACLE_SQL  # noqa: F401

TOKENIZER = "piece_bpe_32k.model"


#: A conversation whose texts consist of control strings, beside those of the table.
TRICKY = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import as_stream, format_log, parse

    rows = read(prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"),
    )
    log = as_stream(rows.unionByName(more), conversation="conv_id", turn="turn", role="role", text="text")
    back = parse(format_log(log))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        F.col("conversation").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    rows = near_duplicates(read(prepare(spark), sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup

    rows = dedup(read(prepare(spark), sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn, predict

    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = predict(docs, learn(docs, allowed=part != 0))
    held_out = F.coalesce(part == 0, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held_out, "language.lang_pred", "language.score", "language.entropy", "language.accepted")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    m = mix(read(prepare(spark), sf_dir, "documents"))
    taken = m.plan.groupBy("row").agg(F.sum("words").alias("taken"))
    per = m.sources.select("src", "source", "source_size", "target")
    sized = m.sized.select("row", F.col("id").alias("doc_id"), "size", "src").join(per, "src").join(taken, "row", "left")
    return sized.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source")


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mpeg import index, store

    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    rows = index(store(docs), strict=True).withColumn("media_bytes", F.length("media").cast("long"))
    return rows.select(
        "doc_id", "info.n_bytes", "info.payload_bytes", "info.payload_sha256", "info.tail_crc32", "media_bytes",
        F.sha2("media", 256).alias("media_sha256"), "info.feature", "info.duration_s", F.size("info.seek").alias("n_frames"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    from .pieces import decode, encode, load_model

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(TOKENIZER)
    model = load_model(model_path)
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    rows = decode(encode(docs, model), model)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, read_archives

    manifest = archive(read(prepare(spark), sf_dir, "pages"), fresh_path(spark, "warc"))
    rows = read_archives(manifest, payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import near_duplicates

    rows = near_duplicates(read(prepare(spark), sf_dir, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    rows = extract(read(prepare(spark), sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (op1_chat, op2_simhash, op3_substring, op4_language, op5_mix, op6_mpeg_audio, op7_sentencepiece, op8_warc, op9_hnsw, op10_html)}
