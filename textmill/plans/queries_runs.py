"""Queries of evaluation runs, their telemetry, and the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import prompts
from textmill.functions import text as T
from textmill.operators import align, budget, events, metrics, preflight, terms, tokens
from textmill.plans.queries import TOKENS, _tokenizer, docs_sql, hashed_sql, words_sql
from textmill.plans.registry import query, table
from textmill.plans.shared import shared_path
from textmill.streaming import incremental

# Functions


@query("select conv_id, turn, case when lower(trim(text)) like 'entailment%' then 'entailment' when lower(trim(text)) like 'contradiction%' then 'contradiction' else 'neutral' end as nli from (select conv_id, turn, case turn % 3 when 0 then ' Entailment: ' when 1 then 'CONTRADICTION ' else '' end || text as text from conversations)")
def parse_nli(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.expr("case turn % 3 when 0 then ' Entailment: ' when 1 then 'CONTRADICTION ' else '' end"), "text").alias("text"))
    return rows.select("conv_id", "turn", T.parse_nli("text").alias("nli"))


@query(f"select doc_id, list_filter([array_to_string({words_sql('text')}, ' '), coalesce(lang, ''), ''], lambda v: v <> '') as spans from documents")
def ner_gold_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    entities = F.array(*[F.struct(x.alias("text")) for x in (T.words("text"), F.array(F.coalesce("lang", F.lit(""))), F.array().cast("array<string>"))])
    return docs.select("doc_id", prompts.ner_gold(entities).alias("spans"))


@query("select doc_id, 'Extract all Disease entities from the text. One per line, no bullets, exact surface forms.' || chr(10) || 'Text: ' || case when doc_id % 3 = 0 and text <> '' then text when doc_id % 3 <> 2 then source else lang || chr(10) || source end || chr(10) || 'Entities:' || chr(10) as prompt from documents where source <> '' and lang <> ''")
def ner_prompt_fields(spark, sf_dir):
    """Text of one field or another, one of them a list."""
    docs = table(spark, sf_dir, "documents").where("source <> '' and lang <> ''")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("text"), F.lit("").alias("document"), F.when(F.col("doc_id") % 3 == 2, F.array("lang", "source")).alias("passages"), F.col("source").alias("abstract"))
    return prompts.ner(rows).select("doc_id", "prompt")


@query("select conv_id, turn, split_part(split_part(text, '. ', 1), 'e', 1) as clipped from conversations")
def stop_clipping(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clip_at("text", [". ", "e"]).alias("clipped"))


@query("select try_cast(trim(k) as int) as tgt_id, max_by(try_cast(trim(v) as int), o) as src_id from (select ' ' || (vec_id % 50) || ' ' as k, case when vec_id % 7 = 0 then 'x' else label::varchar end as v, vec_id as o from embeddings union all select 'bad', '1', 0) where try_cast(trim(k) as int) is not null and try_cast(trim(v) as int) is not null group by 1")
def gold_normalisation(spark, sf_dir):
    """The last value of a key counts."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit(" "), F.col("vec_id") % 50, F.lit(" ")).alias("key"), F.when(F.col("vec_id") % 7 == 0, "x").otherwise(F.col("label").cast("string")).alias("value"), F.col("vec_id").alias("o"))
    return align.normalize_gold(rows.unionByName(spark.createDataFrame([("bad", "1", 0)], "key string, value string, o long")), "o")


@query("with p as (select doc_id, coalesce(length(source) || ':' || source, '-') as a, coalesce(length(lang) || ':' || lang, '-') as b, length(n_chars::varchar) || ':' || n_chars as c from documents) select doc_id, substr(sha1(a || '|' || b || '|' || c), 1, 16) as key from p")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cache_key("source", "lang", "n_chars").alias("key"))


@query("select event_id, case when event_id % 2 = 0 then event_type else event_type || '_f1' end as dataset, case when event_id % 2 = 0 then 'acc' else 'value' end as metric from events")
def metric_names(spark, sf_dir):
    name = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "_acc").otherwise("_f1"))
    dataset, metric = T.metric_name(name)
    return table(spark, sf_dir, "events").select("event_id", dataset.alias("dataset"), metric.alias("metric"))


@query("select conv_id, turn, case when turn % 2 = 0 then upper(regexp_extract(text, '(?i)\\b([ABCD])\\b', 1)) else '' end as first, coalesce(nullif(case when turn % 2 = 0 then upper(regexp_extract(text, '(?i)\\b([ABCD])\\b', 1)) else '' end, ''), role) as filled from conversations")
def fill_empty_predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 0, T.extract_letter("text")).otherwise("").alias("first"))
    return rows.select("conv_id", "turn", "first", T.fill_empty("first", "role").alias("filled"))


# Builds


@query("""select * from (values ('documents', true, 'ok', ''), ('broken', false, 'checksum mismatch: documents.parquet', '')) t(source, ok, reason, failures) where false
    union all select '*', false, 'strict', '[parquet] broken: checksum mismatch: region.parquet' union all select '*', true, 'lenient', '[parquet] broken: checksum mismatch: region.parquet'""")
def preflight_overall(spark, sf_dir):
    """The report of a good source and of one whose file isn't the expected one."""
    specs = [{"name": "good", "paths": [f"{sf_dir}/benchmark.parquet"], "text_fields": ["text"]}, {"name": "broken", "paths": [f"{sf_dir}/region.parquet"], "checksums": {"region.parquet": "deadbeef"}}]
    report = preflight.check_sources(spark, specs)
    line = lambda strict: preflight.overall(report, strict).select(F.lit("*").alias("source"), "ok", F.lit("strict" if strict else "lenient").alias("reason"), F.regexp_replace("failures", r"^\[broken\] parquet", "[parquet] broken").alias("failures"))
    return line(True).unionByName(line(False))


@query("select * from (values ('a', true, 10000000, 20000000), ('b', false, 5, 20000000)) t(name, enabled, target_bytes, total_bytes)")
def quick_overlay(spark, sf_dir):
    sources, total = budget.quick_overlay([{"name": "a", "target_bytes": 1 << 40}, {"name": "b", "target_bytes": 5}], {"b"})
    return spark.createDataFrame([(s["name"], s["enabled"], s["target_bytes"], total) for s in sources], "name string, enabled boolean, target_bytes int, total_bytes int")


@query("select source, sum(n_chars)::bigint as bytes, sum(n_chars) >= greatest(5000000, 400000 // 10) as enough from documents group by source")
def corpus_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"))
    return rows.withColumn("enough", budget.enough("bytes", 400_000))


@query("with p as (select count(distinct source) filter (where source like 'src1%') > 0 as a, count(*) filter (where source like 'src2%') > 0 as b, count(*) filter (where source like 'none%') > 0 as c from documents) select a::int + b::int + c::int as present, a::int + b::int + c::int >= 2 and b as ready from p")
def readiness(spark, sf_dir):
    return events.readiness(table(spark, sf_dir, "documents").select(F.col("source").alias("name")), ["src1", "src2", "none"], "src2", 2)


# Terms and vectors


@query("select token, id from (select distinct p_brand as token, dense_rank() over (order by p_brand)::int - 1 as id from part) union all select 'new' || n, (select count(distinct p_brand) from part)::int + n - 1 from (select unnest(range(1, 4))::int as n)")
def extend_vocabulary(spark, sf_dir):
    """Three new terms behind the vocabulary, and one that it has already."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("token")).distinct()
    vocabulary = brands.withColumn("_g", F.lit(0)).withColumn("_one", F.lit(1))
    vocabulary = budget.running_before(vocabulary, "_g", ["token"], "_one", "id").select("token", F.col("id").cast("int").alias("id"))
    added = spark.createDataFrame([("new1", 0), ("new2", 2), ("new3", 5)], "term string, rank int").unionByName(brands.limit(1).select(F.col("token").alias("term"), F.lit(1).alias("rank")))
    return terms.extend_vocabulary(vocabulary, added)


@query("with v as (select distinct p_brand as id from part), h as (select id from v where substr(md5(id), 1, 1) < '8') select (select count(*) from v) as n, (select count(*) from h) as covered, round((select count(*) from h) / (select count(*) from v), 9) as ratio, (select count(*) from h) / (select count(*) from v) >= 0.5 as enough")
def vector_coverage(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct()
    return align.coverage(ids.where(F.substring(F.md5(F.col("id").cast("binary")), 1, 1) < "8"), ids).withColumn("ratio", F.round("ratio", 9))


N = "(select count(*) from embeddings)"
DRAW = "('0x' || substr(md5('7{}:' || vec_id), 1, 8))::bigint"


@query(f"select vec_id as tgt_id, {DRAW.format('a')} < {int(0.3 * (1 << 32))} as changed, case when {DRAW.format('a')} < {int(0.3 * (1 << 32))} then {DRAW.format('b')} % {N} else label::bigint end as src_id from embeddings")
def ablation_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return align.shuffled(rows.select(F.col("vec_id").alias("tgt_id"), F.col("label").cast("long").alias("src_id")), rows.count(), 0.3, 7)


@query(f"select count(*) as n, count(distinct vec_id) as distinct_sources, {N} - 1 as most, 0::bigint as least, true as moved from embeddings")
def ablation_permute(spark, sf_dir):
    """A permutation hits each source once."""
    rows = table(spark, sf_dir, "embeddings")
    ranks = budget.running_before(rows.select(F.lit(0).alias("_g"), "vec_id", F.lit(1).alias("_one")), "_g", ["vec_id"], "_one", "src_id").select(F.col("vec_id").alias("tgt_id"), "src_id")
    moved = align.permuted(ranks, rows.count(), 3).withColumnRenamed("src_id", "to").join(ranks, "tgt_id")
    return moved.agg(F.count("*").alias("n"), F.countDistinct("to").alias("distinct_sources"), F.max("to").alias("most"), F.min("to").alias("least"), (F.count(F.when(F.col("to") != F.col("src_id"), 1)) > 0).alias("moved"))


QUALITY = f"""w as (select conv_id * 1000 + turn as ord, list_transform({words_sql('text')}, lambda x: ('0x' || substr(md5(x), 1, 4))::bigint % 500) as ids from conversations),
    m as (select vec_id as tgt_id, label::bigint as src_id from embeddings), i as (select min(tgt_id) as tgt_id, src_id from m group by src_id), b as (select tgt_id, min(src_id) as src_id from i group by tgt_id),
    e as (select ord, len(ids) as n, unnest(ids) as tgt_id, unnest(range(len(ids))) as pos from w), j as (select ord, any_value(n) as n, list(src_id order by pos) filter (where src_id is not null) as mapped from e left join b using (tgt_id) group by ord)"""


@query(f"with {QUALITY} select ord, array_to_string(coalesce(mapped, []), ' ') as mapped, round(len(coalesce(mapped, [])) / n, 9) as coverage from j")
def alignment_quality(spark, sf_dir):
    """Token ids taken back by the inverted map, beside the source's own."""
    rows = table(spark, sf_dir, "conversations")
    ids = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.transform(T.words("text"), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("long") % 500).alias("ids"))
    mapping = align.invert(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tgt_id"), F.col("label").cast("long").alias("src_id")))
    made = align.quality(ids, ids, mapping, "ord")
    return made.select("ord", F.array_join(F.transform("mapped", lambda x: x.cast("string")), " ").alias("mapped"), F.round("coverage", 9).alias("coverage"))


@query(f"with {TOKENS}, p as (select conv_id, turn, unnest(w) as token, unnest(range(1, len(w) + 1)) as at from w), v as (select x.token from p x join p y on x.conv_id = y.conv_id and x.turn = y.turn and y.at <> x.at and abs(y.at - x.at) <= 5 group by x.token) select token, 16 as width from v")
def embed_counts(spark, sf_dir):
    """Every word with a neighbour gets a vector; the vectors themselves depend on the factoriser."""
    pairs = terms.cooccurrences(table(spark, sf_dir, "conversations"), 5, "conv_id")
    return terms.embed_counts(pairs, size=16, rounds=3).select("token", F.size("vec").alias("width"))


# Scores


@query("with b as (select source as dataset, doc_id as idx, quality::double as base from labels join documents using (doc_id)), a as (select source as dataset, doc_id as idx, toxic::double as adapted from labels join documents using (doc_id) where not (source = 'src2' and doc_id = (select max(doc_id) from labels join documents using (doc_id) where source = 'src2')) and source <> 'src3'), s as (select dataset from (select dataset, count(*) as n from b group by 1) join (select dataset, count(*) as m from a group by 1) using (dataset) where n = m) select b.dataset, b.idx, base, adapted from b join a using (dataset, idx) where b.dataset in (select dataset from s)")
def paired_runs(spark, sf_dir):
    """Runs that both have a set, with as many rows: one set is missing, one is a row short."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    last = rows.where("source = 'src2'").agg(F.max("doc_id")).first()[0]
    base = rows.select(F.col("source").alias("dataset"), F.col("doc_id").alias("idx"), F.col("quality").cast("double").alias("score"))
    adapted = rows.where("source <> 'src3'").where(F.col("doc_id") != F.lit(last)).select(F.col("source").alias("dataset"), F.col("doc_id").alias("idx"), F.col("toxic").cast("double").alias("score"))
    return metrics.paired(base, adapted)


@query("select user_id, round(avg(value), 6) as mean_nll from events where event_id % 3 <> 0 group by user_id")
def mean_nll(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("nll"), (F.col("event_id") % 3 != 0).cast("int").alias("mask"))
    return tokens.mean_nll_of(rows, "user_id").withColumn("mean_nll", F.round("mean_nll", 6))


@query("with v as (select item_id as row, l as letter, v as variant, case when item_id % 5 = 0 then '-inf'::double else -((('0x' || substr(md5(item_id || v || l), 1, 2))::int % 7)::double) end as ll from benchmark, (select unnest(['A', 'B', 'C', 'D']) as l), (select unnest([0, 1]) as v)), m as (select row, letter, max(ll) as ll from v group by all) select row, case when max(ll) = '-inf'::double then '' else arg_min(letter, -ll * 10 + ascii(letter) / 1000.0) end as choice from m group by row")
def best_variant(spark, sf_dir):
    letters = F.explode(F.array(*map(F.lit, "ABCD"))).alias("letter")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row"), letters).select("row", "letter", F.explode(F.array(F.lit(0), F.lit(1))).alias("variant"))
    draw = F.conv(F.substring(F.md5(F.concat("row", "variant", "letter").cast("binary")), 1, 2), 16, 10).cast("int") % 7
    return metrics.best_variant(rows.withColumn("ll", F.when(F.col("row") % 5 == 0, F.lit(float("-inf"))).otherwise(-draw.cast("double"))))


@query("select item_id as row, case when length(text) % 2 = 0 then 'A' else 'D' end as choice from benchmark")
def suffix_choice(spark, sf_dir):
    """A stand-in for a model: even prompts are likeliest to go on with A, others with D."""
    scorer = lambda: lambda prompts, suffixes: [-abs(ord(s.strip()) - (65 if len(p) % 2 == 0 else 68)) - 0.1 * s.startswith(" ") for p, s in zip(prompts, suffixes, strict=True)]
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row"), F.col("text").alias("prompt"))
    return metrics.best_variant(metrics.suffix_likelihoods(rows, scorer))


@query("select item_id, text || ' and so on' as raw from benchmark")
def generate_hook(spark, sf_dir):
    """A stand-in for a generator."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return tokens.generate(rows, lambda: lambda prompts: [f"{p} and so on" for p in prompts]).select("item_id", "raw")


@query("select round(avg(least(length(a.text), length(b.text)) / greatest(length(a.text), length(b.text), 1)), 9) as mean_similarity from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
def similarity_hook(spark, sf_dir):
    """A stand-in for a model's similarity: the shorter length to the longer."""
    from textmill.plans.queries import _turns

    scorer = lambda: lambda a, b: [min(len(x), len(y)) / max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)]
    return metrics.mean_similarity(_turns(spark, sf_dir), scorer, "p", "r").select(F.round("mean_similarity", 9).alias("mean_similarity"))


@query("with d as (select distinct source as dataset from documents where lang = 'en' intersect select distinct source from documents where lang = 'de') select dataset from d")
def common_datasets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where("lang = 'en'").select(F.col("source").alias("dataset")).intersect(docs.where("lang = 'de'").select("source"))


# Streams


@query("select event_type, min(event_id) as first from events group by event_type")
def stream_recent(spark, sf_dir):
    """The first event of each key, of a stream whose recent keys are kept for a year's watermark."""
    out = shared_path(spark, "recent")
    rows = table(spark, sf_dir, "events").orderBy("event_id").coalesce(1)
    rows.write.parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{out}/in").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "365 days")
    once = incremental.dedup_recent(stream, "event_type")
    once.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/out").select("event_type", F.col("event_id").alias("first"))


@query(f"with d as {docs_sql()}, p as (select source, doc_id as doc_ord, unnest(range(0, case when length(whole) <= 2000 then 1 else (length(whole) - 1) // 1800 + 1 end))::int as chunk_ix, whole from d where whole <> ''), q as (select source, doc_ord, chunk_ix, case when length(whole) <= 2000 then whole else substring(whole, chunk_ix * 1800 + 1, 2000) end as whole from p), x as (select * from q where length(whole) >= 200), {hashed_sql('y', 'x')} select source, doc_ord, chunk_ix, h from y")
def stream_pieces(spark, sf_dir):
    """Three runs of one resumable build, each of which takes the files that are new."""
    out = shared_path(spark, "resumable")
    docs = table(spark, sf_dir, "documents")
    for i in range(3):
        docs.where(F.col("doc_id") % 3 == i).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{out}/in")
        incremental.resumable_pieces(stream, budget.Build(), f"{out}/out", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/out").select("source", "doc_ord", "chunk_ix", "h")


@query("select time_bucket(interval '15 seconds', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_event_lines(spark, sf_dir):
    """Events as JSON lines, read as a stream with a watermark."""
    out = shared_path(spark, "event-lines")
    table(spark, sf_dir, "events").select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "value").write.json(f"{out}/in")
    stream = incremental.event_stream(spark, f"{out}/in", "ts string, value double")
    totals = incremental.tumbling_totals(stream, "ts", "15 seconds", "value")
    totals.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/out")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


# Under real tokenizers, which SQL can't repeat; the same operators are held against SQL under a stand-in.


@query()
def tokens_per_word_bpe(spark, sf_dir):
    return tokens.tokens_per_word(table(spark, sf_dir, "documents"), _tokenizer(spark), "lang")


@query()
def tokenizer_analysis(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return tokens.analysis(docs, terms.select_terms(docs, 200).select("term"), _tokenizer(spark), _tokenizer(spark, "word_bpe_49k.json"), "doc_id")


@query()
def id_corpus_bpe(spark, sf_dir):
    return tokens.id_corpus(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text"), _tokenizer(spark), "ord", 4 << 30)


@query()
def term_top_k_bpe(spark, sf_dir):
    """Terms by the length that a real tokenizer gives them."""
    make = _tokenizer(spark)
    return terms.select_terms(table(spark, sf_dir, "documents"), 200, length=lambda t: F.size(tokens.ids_of(t, make))).select("term", "tf", "iso_len", F.round("score", 6).alias("score"))
