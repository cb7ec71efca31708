"""The queries of this package's operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import audio, clusters, common, html, infill, language, lexicon, licenses, neardup, oracles, packing, pieces, pii, quality, warc

PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The session's setting that has the secret key of surrogates, and what stands for it where none is set, as in tests.
SURROGATE_SETTING, TEST_KEY = "spark.textmill.surrogate.key", "textmill surrogate key"
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> bytes:
    return spark.conf.get(SURROGATE_SETTING, TEST_KEY).encode()


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Near(shingle=3, percent=85))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs).select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), PIECE_MODEL, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audio.audio_features(table(spark, sf_dir, "documents"))
    feature = F.concat_ws(" ", F.concat("n_frames", F.lit(f"x{audio.BANDS}")), F.sha2("tensors", 256), F.to_json("segments"))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), PACKING_TOKENIZER)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    # A response's size and digest are taken from the payload that was read back; of revisits only the headers are read.
    responses = warc.read_warc(spark, path, "page_id long, record_type string, refers_to long, payload binary").where("record_type = 'response'")
    responses = responses.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    revisits = warc.read_warc(spark, path, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string").where("record_type = 'revisit'")
    return responses.unionByName(revisits.select(*responses.columns))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(table(spark, sf_dir, "documents"), outputs=False).drop("output")


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode_words(table(spark, sf_dir, "documents"), PACKING_TOKENIZER, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("scans")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_surrogates": op3_surrogates,
    "op4_language_id": op4_language_id,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_audio_features": op6_audio_features,
    "op7_main_text": op7_main_text,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_license_scan": op9_license_scan,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_word_bpe": op12_word_bpe,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES = {
    "op1_quality_rules": oracles.QUALITY,
    "op2_near_duplicates": r"""
        with recursive w as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        g as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from w),
        r as (select g, min(doc_id) as rep, len(g) as n from (select doc_id, list_sort(g) as g from g) where len(g) > 0 group by g),
        s as (select rep, n, unnest(g) as s from r),
        e as (select a.rep as a, b.rep as b from s a join s b on a.s = b.s and a.rep <> b.rep and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
            group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        c(node, label) as (select rep, rep from r union select e.b, c.label from c join e on e.a = c.node),
        l as (select node, min(label) as label from c group by node),
        m as (select g.doc_id, len(g.g) as n_shingles, case when len(g.g) = 0 then g.doc_id else l.label end as component_id
            from g left join r on list_sort(g.g) = r.g left join l on l.node = r.rep)
        select doc_id, n_shingles, component_id, doc_id = component_id as kept from m""",
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
        f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
        select p.page_id, p.payload_bytes, p.payload_digest,
            case when first is not null and p.page_id <> first then 'revisit' else 'response' end as record_type,
            case when p.page_id <> first then first end as refers_to
        from p left join f using (payload_digest)""",
    "op11_fill_in_middle": oracles.INFILL,
    "op13_centroid_clustering": oracles.CLUSTERING,
}
