"""Queries of sources and sinks: each writes a table in the operator's format and reads it back, and the SQL gives the rows that must come."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import align, budget, tokens
from textmill.plans.queries import HAVE, _build_sql, _built, words_sql
from textmill.plans.registry import digest, digest_sql, query, table
from textmill.plans.shared import exists, shared_path
from textmill.sources import readers, sinks
from textmill.streaming import incremental

# Sources

DOC_LINES = "(select doc_id, lang, source, n_chars from documents)"
DOC_SCHEMA = "doc_id long, lang string, source string, n_chars long"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("with l as (select trim(unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')), ' ' || chr(9) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31)) as text from documents) select text, count(*) as n from l where text <> '' group by text")
def http_line_scan(spark, sf_dir):
    """Staged files of lines, stripped, without blank ones."""
    path = shared_path(spark, "http-lines")
    _docs(spark, sf_dir).where("text is not null").select("text").write.text(path)
    return readers.http_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("select trim(concat_ws(' ', nullif(text, ''), nullif(source, ''))) as text, count(*) as n from documents group by 1 having text <> ''")
def parquet_text_scan(spark, sf_dir):
    return readers.parquet_texts(spark, [f"{sf_dir}/documents.parquet"], ["text", "absent", "source"]).groupBy("text").agg(F.count("*").alias("n"))


@query(DOC_LINES)
def jsonl_tolerant_scan(spark, sf_dir):
    """Lines that are no JSON are left out; a missing path has no row."""
    path = shared_path(spark, "tolerant")
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).unionByName(docs.select(F.concat(F.lit('{"doc_id": '), "doc_id", F.lit(", bad")).alias("value"))).write.text(path)
    return readers.json_lines(spark, path, DOC_SCHEMA).where("doc_id is not null").unionByName(readers.json_lines(spark, f"{path}-missing", DOC_SCHEMA))


@query(DOC_LINES)
def jsonl_strict_scan(spark, sf_dir):
    path = shared_path(spark, "strict")
    _docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars").write.json(path)
    return readers.json_lines(spark, path, DOC_SCHEMA, strict=True)


@query(f"select 't' || vec_id as token, len(embedding) as width, {digest_sql('embedding')} as digest from embeddings")
def vector_lines_round_trip(spark, sf_dir):
    path = shared_path(spark, "vectors")
    sinks.vector_lines(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("t"), "vec_id").alias("token"), F.col("embedding").alias("vec")), path)
    return readers.vectors(spark, path).select("token", F.size("vec").alias("width"), digest("vec").alias("digest"))


@query("select count(*) as rows, max(len(embedding)) as width from embeddings")
def vector_meta(spark, sf_dir):
    path = shared_path(spark, "vectors")
    sinks.vector_lines(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vec")), path)
    return spark.read.schema("rows long, width int").json(f"{path}.meta")


@query("select 'term' || o_orderkey as term from orders order by o_orderkey limit 2048")
def term_list_scan(spark, sf_dir):
    """The first 2048 lines that aren't blank."""
    path = shared_path(spark, "terms")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = orders.select("o_orderkey", F.concat(F.lit("  term"), "o_orderkey", F.lit(" \n \n")).alias("value"))
    lines.orderBy("o_orderkey").select("value").write.text(path)  # files in order, a range of keys each
    return readers.term_list(spark, path)


EVERY = "select doc_id, 0 as field_ix, lang as text from documents where lang <> '' union all select doc_id, 1, source from documents where source <> '' union all select doc_id, 2, lang || chr(10) || source from documents where lang <> '' and source <> ''"


@query(EVERY)
def every_field_union(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("lang <> '' and source <> ''").withColumn("both", F.array("lang", "source"))
    rest = _docs(spark, sf_dir).where("not (lang <> '' and source <> '') or lang is null or source is null").withColumn("both", F.array().cast("array<string>"))
    return readers.every_field(docs.unionByName(rest), ["lang", "absent", "source", "both"], "doc_id")


@query("select ord, text from (select 0 as part, item_id as ord, text from benchmark union all select 1, doc_id, text from documents) order by part, ord limit 2000")
def sample_texts(spark, sf_dir):
    """A second folder's texts follow until the cap is reached."""
    first = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), "text")
    return readers.sample_texts(first, ["ord"], 2000, _docs(spark, sf_dir).select(F.col("doc_id").alias("ord"), "text"))


@query("select conv_id, turn, case when text <> '' then text else role end as text from conversations where coalesce(nullif(text, ''), nullif(role, '')) is not null")
def perplexity_corpus(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array("role").alias("abstract"))
    return readers.perplexity_texts(rows, "conv_id", "turn")


@query('select part_ix, "order", field_ix, text from (select 0 as part_ix, doc_id as "order", 0 as field_ix, lang as text from documents where lang <> \'\' union all select 0, doc_id, 1, source from documents where source <> \'\' union all select 1, item_id, 0, text from benchmark where text <> \'\' union all select 2, page_id, 0, url from pages where url <> \'\') order by part_ix, "order", field_ix limit 20000')
def warmup_texts(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("question"), F.col("source").alias("context"))
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("abstract"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text"))
    fields = ["question", "context", "long_answer", "premise", "hypothesis", "sentence", "text", "abstract"]
    parts = readers.warmup_texts([(docs, "doc_id"), (bench, "item_id"), (pages, "page_id")], fields)
    return parts.select("part_ix", "order", F.when(F.col("field_ix") > 0, (F.col("part_ix") == 0).cast("int")).otherwise(0).alias("field_ix"), "text")


LENGTHS = f"l as (select doc_id, list_transform({words_sql('text')}, lambda v: length(v)) as k from documents)"


def _length_lines(spark, sf_dir):
    """Lines of a document's id, `null` for none, and of its words' lengths; a text without words gives the id alone."""
    lengths = F.transform(T.words("text"), lambda w: F.length(w).cast("string"))
    own = F.array(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return _docs(spark, sf_dir).select(F.array_join(F.concat(own, lengths), " ").alias("line"))


@query(f"with {LENGTHS} select doc_id::varchar as first, len(k) + 1 as n, coalesce(list_sum(k), 0)::bigint as total from l")
def id_sentence_scan(spark, sf_dir):
    path = shared_path(spark, "id-lines")
    sinks.id_lines(_length_lines(spark, sf_dir), path)
    rows = readers.id_sentences(spark, path)
    return rows.select(F.nullif(F.get("tokens", F.lit(0)), F.lit("null")).alias("first"), F.size("tokens").alias("n"), F.aggregate(F.filter("tokens", lambda x, i: i > 0), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("int")).alias("total"))


@query(f"with {LENGTHS} select count(*) as lines, sum(len(k) + 1)::bigint as tokens from l")
def id_line_sidecar(spark, sf_dir):
    path = shared_path(spark, "id-lines")
    sinks.id_lines(_length_lines(spark, sf_dir), path)
    return spark.read.schema("lines long, tokens long").json(f"{path}.stats")


@query("select 'pubmedqa' as name, 'test' as split, item_id, text from benchmark")
def benchmark_staging(spark, sf_dir):
    """Staged from the second candidate, as the first has no such set, and read back; a set that none has is reported empty."""
    folder = shared_path(spark, "benchmarks")

    def fetch(candidate, split):
        if candidate != "second":
            raise LookupError(candidate)
        return table(spark, sf_dir, "benchmark")

    report = readers.stage_benchmarks(spark, fetch, folder, {"pubmedqa": (("test",), ("first", "second")), "none": (("test",), ("first",))})
    staged = report.where("rows > 0").select("name", "split")
    rows = readers.benchmark(spark, folder, "pubmedqa", "test", "item_id long, text string")
    return staged.crossJoin(rows)  # one row with a benchmark's


@query("select item_id, text, 0 as part_ix from benchmark union all select item_id, text, 1 from benchmark")
def split_scan(spark, sf_dir):
    """Of four wanted splits two are there and can be read."""
    import warnings

    def fetch(dataset, split):
        if split == "broken":
            raise OSError("no such split")
        return table(spark, sf_dir, "benchmark")

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return readers.fetch_splits(fetch, lambda d: ["train", "broken", "test"], "set", ["train", "dev", "broken", "test"])


@query("select doc_id, lang from documents qualify row_number() over (partition by lang order by doc_id) <= 7")
def limit_per_dataset(spark, sf_dir):
    return readers.limited(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", ["doc_id"], 7)


@query("select max_by(source, n * 1000000 + doc_id) as name from (select source, doc_id, n_chars as n from documents where lang = 'en')")
def latest_run(spark, sf_dir):
    runs = _docs(spark, sf_dir).select(F.col("source").alias("name"), (F.col("n_chars") * 1000000 + F.col("doc_id")).alias("mtime"), (F.col("lang") == "en").alias("valid"))
    return readers.latest_run(runs)


@query("select item_id, text from benchmark")
def fallback_union(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return readers.first_that_has(bench.where("item_id < -1"), bench)


@query("select 0 as part_ix, item_id as id, text from benchmark union all select 1, doc_id, text from documents")
def concatenation(spark, sf_dir):
    return readers.in_order([table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")])


GRID = "select * from (select unnest([1000, 2000, 4000]) as top_k), (select unnest([100, 300]) as pivot), (select unnest(['cbow', 'glove']) as backend)"


def _grid(spark):
    return readers.grid(spark, top_k=[1000, 2000, 4000], pivot=[100, 300], backend=["cbow", "glove"])


@query(GRID)
def hyper_grid(spark, sf_dir):
    return _grid(spark)


# Sinks


@query(GRID)
def sweep_csv(spark, sf_dir):
    path = shared_path(spark, "sweep")
    sinks.sweep(_grid(spark), path)
    return spark.read.csv(path, header=True, schema="top_k long, pivot long, backend string")


@query("select text, source from documents where source is not null and text is not null union all select text, 'benchmark' from benchmark")
def corpus_jsonl_round_trip(spark, sf_dir):
    """Two appends to one corpus."""
    path = shared_path(spark, "corpus")
    sinks.corpus_lines(_docs(spark, sf_dir).where("source is not null and text is not null"), path)
    sinks.corpus_lines(table(spark, sf_dir, "benchmark").withColumn("source", F.lit("benchmark")), path)
    return spark.read.schema("text string, source string").json(path).select("text", "source")


@query(f"""with {_build_sql(2_000_000, HAVE)}, t as (select l.source, most, count(h) as kept, coalesce(sum(nbytes), 0)::bigint as bytes, max(doc_id) as last from limits l left join built b using (source) group by l.source, most),
    c as (select t.source, (select count(*) from documents d where d.source = t.source and most > 0 and (bytes < most or d.doc_id <= last)) as seen, kept, bytes from t),
    s as (select sum(bytes)::bigint as added, sum(bytes)::bigint + 600000 as total from c)
    select added as added_bytes, total as total_bytes, 2000000 as target_total_bytes, round(100 * total / 2000000, 1) as percent, total >= 2000000 as complete, source, seen, kept, bytes from c, s""")
def corpus_summary_file(spark, sf_dir):
    path = shared_path(spark, "summary")
    options, existing = budget.Build(total_bytes=2_000_000), spark.createDataFrame(list(HAVE.items()), "source string, bytes long")
    docs, sources, built = _built(spark, sf_dir, options, existing)
    sinks.corpus_summary(budget.build_summary(docs, built, sources, options, existing), path, 2_000_000)
    read = spark.read.schema("added_bytes long, total_bytes long, target_total_bytes long, percent double, complete boolean, sources map<string, struct<seen:long,kept:long,bytes:long>>").json(path)
    return read.select("added_bytes", "total_bytes", "target_total_bytes", "percent", "complete", F.explode("sources").alias("source", "c")).select("added_bytes", "total_bytes", "target_total_bytes", "percent", "complete", "source", "c.seen", "c.kept", "c.bytes")


@query("select conv_id, turn, role, text from conversations")
def jsonl_round_trip(spark, sf_dir):
    path = shared_path(spark, "rows")
    rows = table(spark, sf_dir, "conversations")
    sinks.json_rows(rows, path)
    return spark.read.schema(rows.schema).json(path).select("conv_id", "turn", "role", "text")


@query("select text, source from documents order by doc_id limit 500")
def parquet_snapshot(spark, sf_dir):
    path = shared_path(spark, "snapshot")
    sinks.snapshot(_docs(spark, sf_dir), path, ["text", "source"], 500, ["doc_id"])
    return spark.read.parquet(path)


@query("select vec_id as tgt_id, label::bigint as src_id from embeddings")
def alignment_file(spark, sf_dir):
    path = shared_path(spark, "alignment")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tgt_id"), F.col("label").cast("long").alias("src_id"))
    sinks.alignment(rows, path, rows.agg(F.count("*").alias("n")))
    report = spark.read.schema("n long").json(f"{path}.report")
    return spark.read.schema("tgt_id long, src_id long").json(path).join(report, F.lit(True)).where("n > 0").select("tgt_id", "src_id")  # beside one row


METRIC_ROWS = "select 'base' as variant, source as dataset, 'chars' as metric, round(avg(n_chars), 6) as value from documents where source is not null group by source"


def _metric_rows(spark, sf_dir):
    return _docs(spark, sf_dir).where("source is not null").groupBy(F.col("source").alias("dataset")).agg(F.round(F.avg("n_chars"), 6).alias("value")).select(F.lit("base").alias("variant"), "dataset", F.lit("chars").alias("metric"), "value")


@query(f"with m as ({METRIC_ROWS}) select 'csv' as form, * from m union all select 'json', * from m union all select 'folder', * from m")
def metrics_files(spark, sf_dir):
    path, schema = shared_path(spark, "metrics"), "variant string, dataset string, metric string, value double"
    sinks.metrics(_metric_rows(spark, sf_dir), path)
    forms = {"csv": spark.read.csv(f"{path}/results_csv", header=True, schema=schema), "json": spark.read.schema(schema).json(f"{path}/metrics_json"), "folder": spark.read.schema(schema).json(f"{path}/by_dataset").select("variant", "dataset", "metric", "value")}
    parts = [df.select(F.lit(name).alias("form"), "variant", "dataset", "metric", "value") for name, df in forms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("with r as (select role, conv_id, turn, row_number() over (partition by role order by conv_id, turn) as n from conversations) select '## ' || role || ' ' || n as value from r where n <= 5 union all select 'label: ' || conv_id from r where n <= 5")
def samples_file(spark, sf_dir):
    path = shared_path(spark, "samples")
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("dataset"), F.lit("p").alias("prompt"), F.lit("a").alias("pred"), F.col("conv_id").cast("string").alias("label"), "conv_id", "turn")
    sinks.samples(rows, path, ["conv_id", "turn"])
    return spark.read.text(path).where("value like '## %' or value like 'label: %'")


@query("select '| ' || event_type || ' | ' || printf('%.4f', d) || ' | ' || printf('%.4f', d - 1) || ' to ' || printf('%.4f', d + 1) || ' | 0.5000 |' as value from (select event_type, count(*)::double as d from events group by event_type) union all select '| dataset | delta | 95 % interval | p |' union all select '| --- | --- | --- | --- |'")
def statistics_files(spark, sf_dir):
    path = shared_path(spark, "statistics")
    d = F.col("d").cast("double")
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("d")).select("dataset", d.alias("delta_mean"), (d - 1).alias("ci_low"), (d + 1).alias("ci_high"), F.lit(0.5).alias("p_value_two_sided"))
    sinks.statistics(rows, path)
    if not exists(spark, f"{path}/stats_json"):
        raise FileNotFoundError(path)
    return spark.read.text(f"{path}/diagnostics_md")


@query("select event_id, user_id, event_type, value from events")
def event_jsonl_round_trip(spark, sf_dir):
    """Written by a stream in several runs, which go on where the last one ended."""
    path = shared_path(spark, "events")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    for i in range(2):
        rows.where(F.col("event_id") % 2 == i).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        incremental.write_events(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(rows.schema).json(f"{path}/out").select(*rows.columns)


@query("with t as (select p_brand as term, count(*)::double as score from part group by p_brand) select term, (select count(*) from t) as added, (select min(score) from t) as least_score, (select max(score) from t) as most_score from t")
def added_terms_file(spark, sf_dir):
    path = shared_path(spark, "added-terms")
    sinks.term_lines(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("term")).agg(F.count("*").cast("double").alias("score")), path)
    report = spark.read.schema("added long, least_score double, most_score double").json(f"{path}.report")
    return readers.term_list(spark, path, 1 << 30).join(report, F.lit(True))  # beside one row


# Token corpora

FOURS = f"w as (select conv_id * 1000 + turn as ord, {words_sql('text')} as w from conversations), t as (select ord, flatten(list_transform(w, lambda x: list_transform(range(0, (length(x) + 3) // 4), lambda i: least(4, length(x) - 4 * i)))) as ids from w)"
CORPUS = f"{FOURS}, x as (select ord, array_to_string(ids[:4096], ' ') as line from t where len(ids[:4096]) >= 15), z as (select *, coalesce(sum(octet_length(encode(line)) + 1) over (order by ord rows between unbounded preceding and 1 preceding), 0) as before from x)"


def _conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")


@query(f"with {CORPUS} select ord, line from z where before < {4 << 30}")
def id_corpus(spark, sf_dir):
    """Under a tokenizer that SQL can repeat; `id_corpus_bpe` runs a real one."""
    return tokens.id_corpus(_conversations(spark, sf_dir), lambda: tokens.word_lengths(), "ord", 4 << 30)


@query(f"with {CORPUS} select 'base' as tokenizer, ord, line from z where before < 20000 union all select 'adapted', ord, line from z where before < 20000")
def two_id_corpora(spark, sf_dir):
    base, adapted = tokens.two_id_corpora(_conversations(spark, sf_dir).where("false"), lambda: tokens.word_lengths(), lambda: tokens.word_lengths(), "ord", 40_000, _conversations(spark, sf_dir))
    return base.select(F.lit("base").alias("tokenizer"), "ord", "line").unionByName(adapted.select(F.lit("adapted").alias("tokenizer"), "ord", "line"))


@query(f"with {CORPUS}, n as (select len(string_split(line, ' ')) as n from (select * from z order by ord limit 10000)), l as (select list_sort(list(n)) as v, avg(n) as a from n) select len(v) as lines, round(a, 6) as avg, v[round_even(0.5 * (len(v) - 1), 0)::int + 1] as p50, v[round_even(0.9 * (len(v) - 1), 0)::int + 1] as p90 from l")
def id_line_stats(spark, sf_dir):
    lines = tokens.id_corpus(_conversations(spark, sf_dir), lambda: tokens.word_lengths(), "ord", 4 << 30)
    return tokens.line_stats(lines, "ord").withColumn("avg", F.round("avg", 6))


WORD_RATIOS = f"k as (select lang, {words_sql('text')} as w from documents), r as (select lang, list_sum(list_transform(w, lambda x: (length(x) + 3) // 4)) / len(w) as r from k where len(w) > 0), l as (select lang, list_sort(list(r)) as v, avg(r) as a from r group by lang)"


@query(f"with {WORD_RATIOS} select lang, round(a, 6) as avg, round(v[round_even(0.5 * (len(v) - 1), 0)::int + 1], 6) as p50, round(v[round_even(0.9 * (len(v) - 1), 0)::int + 1], 6) as p90 from l")
def tokens_per_word(spark, sf_dir):
    own = tokens.tokens_per_word(_docs(spark, sf_dir), lambda: tokens.word_lengths(), "lang")
    return own.select("lang", *[F.round(c, 6).alias(c) for c in ("avg", "p50", "p90")])


@query("with e as (select regexp_extract_all(text, '" + T.ENTITY + "')[:16] as e from (select * from documents order by doc_id limit 256)), x as (select unnest(e) as e from e) select count(*) as entities, round(avg((len(string_split(e, ' ')) = 1 and length(e) <= 4)::int), 9) as coverage from x")
def entity_atomic_coverage(spark, sf_dir):
    own = tokens.atomic_coverage(_docs(spark, sf_dir), lambda: tokens.word_lengths(), "doc_id")
    return own.withColumn("coverage", F.round("coverage", 9))


@query("select distinct p_brand as term, list_sum(list_transform(string_split(p_brand, ' '), lambda x: (length(x) + 3) // 4))::int as base_len, len(string_split(p_brand, ' '))::int as adapted_len, (list_sum(list_transform(string_split(p_brand, ' '), lambda x: (length(x) + 3) // 4)) - len(string_split(p_brand, ' ')))::int as reduction from part")
def fragmentation_delta(spark, sf_dir):
    words = lambda: lambda texts: [[len(w) for w in t.split()] for t in texts]
    return tokens.fragmentation(table(spark, sf_dir, "part").select(F.col("p_brand").alias("term")), lambda: tokens.word_lengths(), words)


@query(f"select tensor, page_id as row_id, v from (select unnest(['model.embed_tokens.weight', 'lm_head.weight']) as tensor), (select a.vec_id as page_id, {digest_sql('b.embedding')} as v from embeddings a join embeddings b on b.vec_id = a.label) union all select 'norm.weight', vec_id, {digest_sql('embedding')} from embeddings")
def remap_model(spark, sf_dir):
    """The rows of a model's embedding and head are gathered anew, other tensors stay."""
    rows = table(spark, sf_dir, "embeddings")
    tensors = rows.select(F.explode(F.array(*map(F.lit, ("model.embed_tokens.weight", "lm_head.weight", "norm.weight")))).alias("tensor"), F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    moved = align.remap(tensors, rows.select(F.col("vec_id").alias("tgt_id"), F.col("label").cast("long").alias("src_id")), "mistral")
    return moved.select("tensor", "row_id", digest("vec").alias("v"))
