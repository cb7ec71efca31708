"""The registered queries: each operator over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import prompts
from textmill.functions import text as T
from textmill.operators import align, budget, dedup, events, metrics, preflight, spaces, terms, tokens, vectors
from textmill.plans.registry import digest, digest_sql, query, table
from textmill.plans.shared import materialize, shared_path
from textmill.streaming import incremental

TARGET, TOTAL, SEED, SAMPLES, WINDOW_S = 50_000, 600_000, 17, 1000, "15 seconds"
SOURCES = [f"src{i}" for i in range(20)]


# SQL of the scalar functions.


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{T.WS}+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{T.WS}+'), lambda v: v <> '')"


def hashed_sql(name: str, source: str) -> str:
    """CTEs that end in `name`: the columns of source, which has a column whole, and h."""
    return f"""
        {name}_k as (select *, list_filter(string_split(trim(regexp_replace(lower(whole), '[^a-z0-9 ]+', ' ', 'g')), ' '), lambda v: v <> '') as k from {source}),
        {name} as (select * exclude (k), case when len(k) < 3 then sha1(array_to_string(k, ' '))
            else sha1(unhex(array_to_string(list_transform(range(1, len(k) - 1), lambda i: md5(k[i] || ' ' || k[i + 1] || ' ' || k[i + 2])), ''))) end as h from {name}_k)"""


def docs_sql(where: str = "true", tab: str = "documents") -> str:
    return f"(select *, {norm_sql('text')} as whole from {tab} where {where})"


def pieces_sql(most: int, source: str = "(select * from d)") -> str:
    step = most - min(200, most // 10)
    return f"""select *, case when length(whole) <= {most} then whole else substring(whole, chunk_ix * {step} + 1, {most}) end as piece
        from (select *, unnest(range(0, case when length(whole) <= {most} then 1 else (length(whole) - 1) // {step} + 1 end))::int as chunk_ix from {source})"""


NBYTES = "octet_length(encode(to_json({'text': piece, 'source': source})::varchar)) + 3"

# Texts


@query(f"select doc_id, {norm_sql('text')} as norm, length({norm_sql('text')}) as n from documents")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_text("text").alias("norm")).withColumn("n", F.length("norm"))


@query(f"with {hashed_sql('x', docs_sql())} select doc_id, h from x")
def hash_3gram(spark, sf_dir):
    return dedup.hashed(table(spark, sf_dir, "documents")).select("doc_id", "h")


@query(f"with {hashed_sql('x', docs_sql())} select doc_id, h from x")
def hash_3gram_native(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.hash_3gram_native(T.norm_text("text")).alias("h"))


@query(f"with d as {docs_sql()} select doc_id, chunk_ix, piece from ({pieces_sql(1000)})")
def chunk_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.norm_text("text").alias("whole"))
    return docs.select("doc_id", F.posexplode(T.chunks("whole", 1000)).alias("chunk_ix", "piece"))


@query(f"with d as {docs_sql()} select doc_id, chunk_ix, length(piece) as n from ({pieces_sql(1000)}) where length(piece) >= 200")
def min_len_filter(spark, sf_dir):
    return chunk_text(spark, sf_dir).select("doc_id", "chunk_ix", F.length("piece").alias("n")).where("n >= 200")


@query("""select doc_id, case when coalesce(lang, '') <> '' then lang else coalesce(source, '') end as first_field,
    trim(concat_ws(' ', nullif(lang, ''), nullif(source, ''))) as all_fields,
    concat_ws(chr(10), nullif(lang, ''), nullif(source, '')) as listed, concat_ws(chr(10), nullif(source, ''), nullif(lang, ''), nullif(source, '')) as structured,
    concat_ws(chr(10), nullif(lang, ''), nullif(lang, ''), nullif(source, '')) as many from documents""")
def text_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.array("lang", "source").alias("list"))
    docs = docs.withColumn("one", F.struct("source", "n_chars", F.col("list").alias("own"))).withColumn("many", F.array(F.struct("lang", "n_chars"), F.lit(None).cast("struct<lang:string,n_chars:bigint>"), F.struct("lang", "n_chars")))
    docs = docs.withColumn("mixed", F.array(F.struct("lang", F.array("lang", "source").alias("own"))))
    first = T.coalesce_text("lang", "source").alias("first_field")
    return docs.select("doc_id", first, T.concat_text("lang", "source").alias("all_fields"), T.first_text(docs, "absent", "list").alias("listed"), T.first_text(docs, "one").alias("structured"), T.first_text(docs, "mixed").alias("many"))


@query(f"select doc_id, len({words_sql('text')}) as n_words from documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("n_words"))


@query(f"with e as (select doc_id, regexp_extract_all(text, '{T.ENTITY}') as e from documents) select doc_id, len(e) as n, coalesce(list_sum(list_transform(e, lambda x: length(x))), 0)::bigint as chars from e")
def naive_entities(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", T.naive_entities("text").alias("e"))
    return e.select("doc_id", F.size("e").alias("n"), F.length(F.array_join("e", "")).cast("long").alias("chars"))


# Duplicates


@query(f"with {hashed_sql('x', docs_sql())} select min(doc_id) as doc_id, h from x group by h")
def exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "h")


@query(f"with {hashed_sql('x', docs_sql())}, {hashed_sql('b', docs_sql(tab='benchmark'))} select doc_id, h from x where h not in (select h from b)")
def decontaminate(spark, sf_dir):
    seen = dedup.blocklist(table(spark, sf_dir, "benchmark"), "text")
    return dedup.without(dedup.hashed(table(spark, sf_dir, "documents")), seen).select("doc_id", "h")


@query(f"with {hashed_sql('x', docs_sql())} select doc_id, h from x where source <> 'src0' and h not in (select h from x where source = 'src0')")
def seen_store_antijoin(spark, sf_dir):
    rows = dedup.hashed(table(spark, sf_dir, "documents")).select("doc_id", "source", "h")
    return dedup.without(rows.where("source <> 'src0'"), rows.where("source = 'src0'").select("h").distinct()).select("doc_id", "h")


@query(f"with {hashed_sql('x', docs_sql())} select distinct h from x where h not in (select h from x where lang = 'en')")
def backfill_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return dedup.backfill(dedup.hashed(docs.where("lang = 'en'")).select("h").distinct(), docs)


MINHASH = """
    w as (select doc_id, list_distinct({words}) as w from documents),
    v as (select doc_id, w, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint) as v from w where len(w) > 0),
    s as (select doc_id, w, [{mins}] as s from v),
    b as (select doc_id, unnest([{bands}], recursive := true) from s),
    f as (select band, key, min(doc_id) as first from b group by band, key),
    c as (select distinct first, doc_id as other from b join f using (band, key) where doc_id > first)"""
MINHASH = MINHASH.format(
    words=words_sql("lower(text)"),
    mins=", ".join(f"list_min(list_transform(v, lambda x: ({a} * x + {b}) % {dedup.PRIME}))" for a, b in dedup.permutations(63)),
    bands=", ".join("{'band': %d, 'key': concat_ws('-', %s)}" % (b, ", ".join(f"s[{21 * b + r + 1}]" for r in range(21))) for b in range(3)),
)


@query(f"with {MINHASH} select first, other from c")
def minhash_candidates(spark, sf_dir):
    return dedup.near_candidates(table(spark, sf_dir, "documents"), bands=3, rows=21)


@query(f"with {MINHASH} select first, other, round(len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))), 9) as similarity from c join w x on x.doc_id = first join w y on y.doc_id = other")
def jaccard_verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pairs = materialize(dedup.near_candidates(docs, bands=3, rows=21), "near-pairs")
    return dedup.jaccard(pairs, docs).withColumn("similarity", F.round("similarity", 9))


@query()
def near_dup_groups(spark, sf_dir):
    return dedup.near_groups(table(spark, sf_dir, "documents"))


@query()
def near_dup_greedy(spark, sf_dir):
    return dedup.greedy_near_dedup(table(spark, sf_dir, "documents"))


# Budgets

SIZED = f"d as {docs_sql()}, s as (select source, doc_id, {NBYTES} as nbytes from (select *, whole as piece from d))"
CUT = f"{SIZED}, r as (select *, coalesce(sum(nbytes) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from s), c as (select * from r where before < {TARGET})"


def _sized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", T.norm_text("text").alias("text"))
    return docs.select("source", "doc_id", T.json_bytes("text", "source").alias("nbytes"))


def _targets(spark, target=TARGET):
    return spark.createDataFrame([(s, i, target) for i, s in enumerate(SOURCES)], "source string, ord int, target_bytes long")


@query(f"with {CUT} select source, doc_id, nbytes, before from c")
def byte_budget_per_source(spark, sf_dir):
    return budget.within_budget(_sized(spark, sf_dir), _targets(spark).drop("ord"), ["doc_id"]).select("source", "doc_id", "nbytes", "before")


@query(f"""with {CUT}, w as (select source, substr(source, 4)::int as ord, sum(nbytes) as wanted from c group by source),
    g as (select source, greatest(0, least({TARGET}, {TOTAL} - coalesce(sum(least({TARGET}, wanted)) over (order by ord rows between unbounded preceding and 1 preceding), 0)))::bigint as target_bytes from w),
    k as (select source, count(*) as kept, sum(nbytes)::bigint as bytes from c join g using (source) where before < target_bytes group by source)
    select source, target_bytes, coalesce(kept, 0) as kept, coalesce(bytes, 0)::bigint as bytes from g left join k using (source)""")
def global_budget(spark, sf_dir):
    sized = _sized(spark, sf_dir)
    own = budget.summary(budget.within_budget(sized, _targets(spark).drop("ord"), ["doc_id"])).collect()  # a row for each configured source
    wanted = {r["source"]: r["bytes"] for r in own}
    targets = spark.createDataFrame(budget.effective_targets([(s, TARGET) for s in SOURCES if s in wanted], {}, wanted, TOTAL), "source string, target_bytes long")
    kept = budget.summary(budget.within_budget(sized, targets, ["doc_id"]))
    return targets.join(kept, "source", "left").select("source", "target_bytes", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query(f"with {CUT} select source, count(*) as kept, sum(nbytes)::bigint as bytes, (sum(nbytes) + count(*))::bigint as file_bytes from c group by source")
def corpus_summary(spark, sf_dir):
    return budget.summary(budget.within_budget(_sized(spark, sf_dir), _targets(spark).drop("ord"), ["doc_id"]))


HAVE = {"src1": 100_000, "src3": 500_000}


def _build_sql(total: int | None = None, have: dict[str, int] | None = None) -> str:
    """CTEs k0, k1, ... of the rows that each source keeps, and their union `built`."""
    o, have = budget.Build(), have or {}
    parts = [f"d as {docs_sql()}", f"p as (select source, doc_id, chunk_ix, piece, piece as whole from ({pieces_sql(o.most_chars, '(select source, doc_id, whole from d)')}) where length(piece) >= {o.least_chars})", hashed_sql("q", "p"), hashed_sql("b", docs_sql(tab="benchmark"))]
    parts.append(f"a as materialized (select source, doc_id, chunk_ix, h, {NBYTES} as nbytes from q where h not in (select h from b))")
    parts.append("u as materialized (select *, row_number() over (partition by source, h order by doc_id, chunk_ix) as n from a)")
    for i, source in enumerate(SOURCES):
        block = "".join(f" and h not in (select h from k{j})" for j in range(i))
        most = str(max(0, o.target_bytes - have.get(source, 0)))
        if total is not None:
            earlier = "".join(f" - coalesce((select sum(nbytes) from k{j}), 0)" for j in range(i))
            most = f"least({most}, greatest(0, {total - sum(have.values())}{earlier}))"
        parts.append(f"k{i} as materialized (select * from (select *, coalesce(sum(nbytes) over (order by doc_id, chunk_ix rows between unbounded preceding and 1 preceding), 0) as before from u where n = 1 and source = '{source}'{block}) where before < {most})")
        parts.append(f"l{i} as (select '{source}' as source, {most} as most)")
    every = lambda k, what: " union all ".join(f"select {what} from {k}{i}" for i in range(len(SOURCES)))
    return f"{', '.join(parts)}, built as materialized ({every('k', 'source, doc_id, chunk_ix, h, nbytes')}), limits as ({every('l', 'source, most')})"


def _built(spark, sf_dir, options=budget.Build(), existing=None):
    sources = _targets(spark, options.target_bytes)
    docs = table(spark, sf_dir, "documents")
    return docs, sources, budget.build_corpus(docs, table(spark, sf_dir, "benchmark"), sources, options, existing)


@query(f"with {_build_sql()} select source, doc_id as doc_ord, chunk_ix, h, nbytes::bigint as nbytes from built")
def corpus_build(spark, sf_dir):
    return _built(spark, sf_dir)[2].select("source", "doc_ord", "chunk_ix", "h", "nbytes")


@query(f"with {_build_sql(2_000_000, HAVE)} select source, doc_id as doc_ord, chunk_ix, h from built")
def corpus_build_resumed(spark, sf_dir):
    """With a cap on all sources together and bytes that earlier runs wrote."""
    existing = spark.createDataFrame(list(HAVE.items()), "source string, bytes long")
    return _built(spark, sf_dir, budget.Build(total_bytes=2_000_000), existing)[2].select("source", "doc_ord", "chunk_ix", "h")


@query(f"""with {_build_sql(2_000_000, HAVE)}, t as (select l.source, most, count(h) as kept, coalesce(sum(nbytes), 0)::bigint as bytes, max(doc_id) as last from limits l left join built b using (source) group by l.source, most)
    select t.source, (select count(*) from documents d where d.source = t.source and most > 0 and (bytes < most or d.doc_id <= last)) as seen, kept, bytes, (bytes + case t.source when 'src1' then 100000 when 'src3' then 500000 else 0 end)::bigint as total_bytes from t""")
def corpus_build_counts(spark, sf_dir):
    options, existing = budget.Build(total_bytes=2_000_000), spark.createDataFrame(list(HAVE.items()), "source string, bytes long")
    docs, sources, built = _built(spark, sf_dir, options, existing)
    return budget.build_summary(docs, built, sources, options, existing)


@query()
def corpus_build_near_dup(spark, sf_dir):
    """With near duplicates dropped."""
    return _built(spark, sf_dir, budget.Build(near_dup=True))[2].select("source", "doc_ord", "chunk_ix", "h")


@query("""select * from (values ('documents', 'parquet', true, 'ok', 'text'), ('pages', 'parquet', true, 'ok', 'html'), ('benchmark', 'parquet', true, 'ok', 'text'), ('region', 'parquet', false, 'no requested column', '')) t(source, split, ok, reason, fields_present)""")
def preflight_report(spark, sf_dir):
    specs = [{"name": n, "paths": [f"{sf_dir}/{n}.parquet"], "text_fields": ["text", "html"]} for n in ("documents", "pages", "benchmark", "region")]
    return preflight.check_sources(spark, specs).withColumn("fields_present", F.concat_ws(",", "fields_present"))


# Terms

TERM_STATS = rf"""t as (select doc_id, unnest(regexp_extract_all(text, '{T.TERM}')) as term from documents),
    st as (select term, count(*) as tf, count(distinct doc_id) as df, min(doc_id) as first_doc from t where length(term) <= 64 group by term)"""
SCORE = "greatest(0, ceil(length(term) / 4) - 1) * tf * ln((select count(*) from documents) / df)"


@query(f"with {TERM_STATS} select term, tf from st")
def term_freq(spark, sf_dir):
    return terms.statistics(table(spark, sf_dir, "documents")).select("term", "tf")


@query(f"with {TERM_STATS} select term, df, first_doc from st")
def doc_freq(spark, sf_dir):
    return terms.statistics(table(spark, sf_dir, "documents")).select("term", "df", "first_doc")


@query(f"with {TERM_STATS} select term, tf, df, round({SCORE}, 6) as score from st")
def term_score_tfidf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return terms.scored(terms.statistics(docs), docs.count()).select("term", "tf", "df", F.round("score", 6).alias("score"))


@query(f"with {TERM_STATS}, top as (select * from st order by tf desc, first_doc, term limit 600) select term, tf, round({SCORE}, 6) as score from top where ceil(length(term) / 4) > 1 order by {SCORE} desc, tf desc, first_doc, term limit 200")
def term_top_k(spark, sf_dir):
    return terms.select_terms(table(spark, sf_dir, "documents"), 200).select("term", "tf", F.round("score", 6).alias("score"))


@query(f"with {TERM_STATS} select term, tf from st where term not in (select unnest(regexp_extract_all(text, '{T.TERM}')) from benchmark)")
def term_antijoin_vocabulary(spark, sf_dir):
    base = table(spark, sf_dir, "benchmark").select(F.explode(T.terms("text")).alias("term"))
    return terms.statistics(table(spark, sf_dir, "documents"), base).select("term", "tf")


TOKENS = f"w as (select conv_id, turn, {words_sql('lower(text)')} as w from conversations)"


@query(f"with {TOKENS}, t as (select unnest(w) as token from w) select token, count(*) as n from t group by token having count(*) >= 5")
def vocab_count(spark, sf_dir):
    return terms.vocabulary_counts(table(spark, sf_dir, "conversations"), 5)


@query(f"""with {TOKENS}, p as (select conv_id, turn, unnest(w) as token, unnest(range(1, len(w) + 1)) as at from w),
    j as (select least(x.token, y.token) as a, greatest(x.token, y.token) as b, 1.0::double / (y.at - x.at) as weight from p x join p y on x.conv_id = y.conv_id and x.turn = y.turn and y.at > x.at and y.at <= x.at + 5)
    select a, b, round(sum(weight), 6) as weight from j group by a, b""")
def cooccur_window(spark, sf_dir):
    return terms.cooccurrences(table(spark, sf_dir, "conversations"), 5, "conv_id").withColumn("weight", F.round("weight", 6))


@query()
def word2vec(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(T.words(F.lower("text")).alias("tokens"))
    return vectors.train_words(lines, size=300, window=15, epochs=5).select("token", "vec")


# Metrics

PREDICTED = "p as (select source as dataset, doc_id, case when n_chars > 600 then '1' else '0' end as pred, quality::varchar as label, quality, toxic from labels join documents using (doc_id))"


def _predicted(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return rows.select(F.col("source").alias("dataset"), "doc_id", F.when(F.col("n_chars") > 600, "1").otherwise("0").alias("pred"), F.col("quality").cast("string").alias("label"), "quality", "toxic")


@query(f"with {PREDICTED} select dataset, count(*) as n, round(avg((pred = label)::int), 9) as accuracy from p group by dataset")
def accuracy_by_dataset(spark, sf_dir):
    return metrics.accuracy(_predicted(spark, sf_dir), "dataset").withColumn("accuracy", F.round("accuracy", 9))


HALVES = "hv as (select text[1:ceil(length(text) / 2)::int] as a, text[ceil(length(text) / 2)::int + 1:] as b from documents)"
ENT = lambda x: f"list_distinct(list_transform(regexp_extract_all({x}, '{T.ENTITY}'), lambda x: regexp_replace(lower(x), '{T.WS}+', ' ', 'g')))"
SPANS = f"""{HALVES}, s as (select {ENT('a')} as p, {ENT('b')} as g from hv),
    n as (select len(list_intersect(p, g)) as tp, len(p) - len(list_intersect(p, g)) as fp, len(g) - len(list_intersect(p, g)) as fn from s),
    m as (select sum(tp) / sum(tp + fp) as p, sum(tp) / sum(tp + fn) as r, avg(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 1.0 end) as macro from n)"""


def _halves(spark, sf_dir):
    """The first and the second half of each whole text."""
    half = F.ceil(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select(F.substr("text", F.lit(1), half).alias("a"), F.substr("text", half + 1).alias("b"))


@query(f"with {SPANS} select round(p, 9) as micro_p, round(r, 9) as micro_r, round(2 * p * r / (p + r), 9) as micro_f1, round(macro, 9) as macro_f1 from m")
def ner_span_f1(spark, sf_dir):
    s = metrics.span_scores(_halves(spark, sf_dir).select(T.naive_entities("a").alias("pred"), T.naive_entities("b").alias("gold")))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


TERMSETS = f"{HALVES}, s as (select list_distinct(list_filter(regexp_extract_all(a, '{T.TERM}'), lambda t: length(t) <= 64)) as p, list_distinct(list_filter(regexp_extract_all(b, '{T.TERM}'), lambda t: length(t) <= 64)) as g from hv)"


@query(f"with {TERMSETS}, n as (select sum(len(list_intersect(p, g))) as tp, sum(len(p)) as np, sum(len(g)) as ng from s), m as (select tp / np as p, tp / ng as r from n) select round(p, 9) as precision, round(r, 9) as recall, round(2 * p * r / (p + r), 9) as f1 from m")
def term_prf(spark, sf_dir):
    s = metrics.set_scores(_halves(spark, sf_dir).select(T.terms("a").alias("p"), T.terms("b").alias("r")), "p", "r")
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query("select event_type, round(exp(avg(value / 100)), 6) as perplexity from events group by event_type")
def perplexity(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.round(metrics.perplexity(F.col("value") / 100), 6).alias("perplexity"))


CHOICE = r"""select conv_id, turn, coalesce(
    upper(list_extract(regexp_extract_all(text, '(?i)(?:final\s*answer|answer|choice|option|letter)\s*[:=\-]?\s*([ABCD])(?:[^a-z]|$)', 1), -1)),
    upper(list_extract(regexp_extract_all(text, '(?i)[\(\[\{]\s*([ABCD])\s*[\)\]\}]', 1), -1)),
    upper(nullif(regexp_extract(text, '(?i)([ABCD])(?:[^a-z]|$)', 1), '')),
    translate(list_extract(list_filter(regexp_split_to_array(text, '[^0-9]+'), lambda v: v in ('1', '2', '3', '4')), -1), '1234', 'ABCD'), '') as choice,
    upper(regexp_extract(text, '(?i)\b([ABCD])\b', 1)) as letter from conversations"""


@query(CHOICE)
def extract_choice(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.extract_choice("text").alias("choice"), T.extract_letter("text").alias("letter"))


@query("""select conv_id, turn, case when lower(trim(text)) like 'yes%' then 'yes' when lower(trim(text)) like 'no%' then 'no' else 'maybe' end as answer,
    case when lower(trim(text)) like 'entailment%' then 'entailment' when lower(trim(text)) like 'contradiction%' then 'contradiction' else 'neutral' end as nli from conversations""")
def parse_yes_no(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_yes_no("text").alias("answer"), T.parse_nli("text").alias("nli"))


@query("""with l as (select conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as s from conversations)
    select conv_id, turn, len(s) as n_spans, array_to_string(s, '|') as spans from l""")
def parse_spans(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_spans("text").alias("s"))
    return s.select("conv_id", "turn", F.size("s").alias("n_spans"), F.array_join("s", "|").alias("spans"))


@query("with l as (select lang, list_sort(list(n_chars)) as v from documents group by lang) select lang, v[round_even(0.5 * (len(v) - 1), 0)::int + 1] as p50, v[round_even(0.9 * (len(v) - 1), 0)::int + 1] as p90 from l")
def nearest_rank_pct(spark, sf_dir):
    return metrics.nearest_rank(table(spark, sf_dir, "documents"), "lang", "n_chars", {"p50": 0.5, "p90": 0.9})


TURNS = "m as (select a.text as p, b.text as r from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"


def _turns(spark, sf_dir):
    """Each turn beside the one that follows it."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.col("text").alias("p")).join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r")), ["conv_id", "turn"]).select("p", "r")


@query(f"with {TURNS}, w as (select row_number() over () as i, {words_sql('lower(p)')} as p, {words_sql('lower(r)')} as r from m), t as (select i, unnest(p) as v from w), u as (select i, unnest(r) as v from w), pc as (select i, v, count(*) as n from t group by all), rc as (select i, v, count(*) as n from u group by all), h as (select sum(least(pc.n, rc.n)) as hit from pc join rc using (i, v)), n as (select sum(len(p)) as c, sum(len(r)) as q from w) select round(100 * case when c >= q then 1 else exp(1 - q / c) end * hit / c, 7) as bleu_1 from h, n")
def token_bleu_1(spark, sf_dir):
    own = _turns(spark, sf_dir).select(T.words(F.lower("p")).alias("p"), T.words(F.lower("r")).alias("r"))
    return metrics.bleu_1(own, "p", "r").select(F.round("bleu_1", 7).alias("bleu_1"))


def _tokens_13a_sql(x: str) -> str:
    out = f"trim({x})"
    for a, b in [("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), *[(f"'{a}'", f"'{b}'") for a, b in metrics.ENTITIES_13A]]:
        out = f"replace({out}, {a}, {b})"
    out = f"' ' || {out} || ' '"
    for pattern, put in metrics.TOKENS_13A:
        out = f"regexp_replace({out}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '[\\x09-\\x0D\\x1C-\\x20]+'), lambda v: v <> '')"


BLEU = f"""{TURNS}, w as (select row_number() over () as i, {_tokens_13a_sql('p')} as p, {_tokens_13a_sql('r')} as r from m),
    gp as (select i, n, array_to_string(p[k:k + n - 1], ' ') as g from w, (select unnest(range(1, 5)) as n), lateral (select unnest(range(1, len(p) - n + 2)) as k)),
    gr as (select i, n, array_to_string(r[k:k + n - 1], ' ') as g from w, (select unnest(range(1, 5)) as n), lateral (select unnest(range(1, len(r) - n + 2)) as k)),
    cp as (select i, n, g, count(*) as c from gp group by all), cr as (select i, n, g, count(*) as c from gr group by all),
    h as (select n, sum(cp.c) as total, sum(least(cp.c, coalesce(cr.c, 0))) as hit from cp left join cr using (i, n, g) group by n),
    z as (select *, sum((hit = 0)::int) over (order by n) as misses from h),
    l as (select sum(ln(case when hit > 0 then hit / total else 1 / (2 ^ misses * total) end)) as logs, max(hit) filter (where n = 1) as first, max(total) filter (where n = 4) as last from z),
    n as (select sum(len(p)) as c, sum(len(r)) as q from w)"""


@query(f"with {BLEU} select round(case when first > 0 and last > 0 then 100 * case when c >= q then 1.0 else exp(1 - q / c) end * exp(logs / 4) else 0.0 end, 6) as bleu from l, n")
def corpus_bleu(spark, sf_dir):
    return metrics.bleu(_turns(spark, sf_dir), "p", "r").select(F.round("bleu", 6).alias("bleu"))


@query()
def rouge_l(spark, sf_dir):
    return metrics.rouge_l(_turns(spark, sf_dir), "p", "r")


@query("select role, count(*) as n, count(*) filter (where nullif(upper(regexp_extract(text, '(?i)\\b([ABCD])\\b', 1)), '') is not null) as parsed from conversations group by role")
def parse_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", T.extract_letter("text").alias("letter"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.count(F.when(F.col("letter") != "", 1)).alias("parsed"))


LOGGED = "case when event_id % 7 = 0 then 'HTTP 503 Service Unavailable' when event_id % 11 = 0 then 'CUDA out of memory' when event_id % 13 = 0 then 'Retrying: ModuleNotFoundError' else props end"


@query(f"with l as (select event_type, lower({LOGGED}) as line from events) select event_type, count(*) filter (where regexp_matches(line, '{'|'.join(T.TRANSIENT)}')) as transient, count(*) filter (where regexp_matches(line, '{'|'.join(T.FATAL)}')) as fatal from l group by event_type")
def log_classification(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("line", F.expr(LOGGED))
    return rows.groupBy("event_type").agg(F.count(F.when(T.contains_any("line", T.TRANSIENT), 1)).alias("transient"), F.count(F.when(T.contains_any("line", T.FATAL), 1)).alias("fatal"))


# Vectors

UNIT = "u as (select vec_id, embedding, label, list_transform(embedding, lambda x: x::double / case when n = 0 then 1 else n end) as unit from (select *, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings))"


@query(f"with {UNIT} select vec_id, round(list_inner_product(unit, unit), 6) as n2, {digest_sql('unit')} as digest from u")
def vec_normalize(spark, sf_dir):
    u = align.with_unit(table(spark, sf_dir, "embeddings"), "embedding")
    return u.select("vec_id", F.round(align.dot("unit", "unit"), 6).alias("n2"), digest("unit").alias("digest"))


VOCAB = "{a} as (select distinct token, ('0x' || substr(md5('{l}' || token), 1, 8))::bigint as id from (select unnest(" + words_sql("text").replace("{", "{{").replace("}", "}}") + ") as token from documents where lang = '{l}'))"


@query(f"with {VOCAB.format(a='t', l='es')}, {VOCAB.format(a='s', l='fr')} select t.id as tgt_id, s.id as src_id from t join s using (token)")
def gold_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")

    def vocabulary(lang):
        own = docs.where(F.col("lang") == lang).select(F.explode(T.words("text")).alias("token")).distinct()
        return own.select("token", F.conv(F.substring(F.md5(F.concat(F.lit(lang), "token").cast("binary")), 1, 8), 16, 10).cast("long").alias("id"))

    return align.gold_overlap(vocabulary("es"), vocabulary("fr"))


PIVOTS = "p as (select (row_number() over (order by h, vec_id) - 1)::int as pivot_ix, unit as pv from (select *, md5('0:' || vec_id) as h from u) qualify row_number() over (order by h, vec_id) <= 16)"


@query(f"with {UNIT}, {PIVOTS} select vec_id, pivot_ix, round(list_inner_product(unit, pv), 5) as sim from u, p")
def relative_rep(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    picked = align.pick_pivots(vectors, 16).agg(F.sort_array(F.collect_list(F.struct(F.md5(F.concat_ws(":", F.lit(0), "id").cast("binary")), "id", "vec"))).alias("p"))  # sixteen
    pivots = picked.select(F.posexplode(F.transform("p", lambda x: x["vec"])).alias("pivot_ix", "vec"))
    rel = spaces.relative(vectors, pivots)
    return rel.select(F.col("id").alias("vec_id"), F.posexplode("rel").alias("pivot_ix", "sim")).withColumn("sim", F.round("sim", 5))


TOP2 = f"""{UNIT}, c as (select x.vec_id as id, y.vec_id as cand, round(list_inner_product(x.unit, y.unit), 9) as sim from u x, u y),
    r as (select *, row_number() over (partition by id order by sim desc, cand) as n from c),
    t2 as (select a.id, a.cand as best_id, a.sim as best_sim, b.cand as second_id, b.sim as second_sim from r a join r b on a.id = b.id and a.n = 1 and b.n = 2)"""


def _top2(spark, sf_dir):
    unit = align.with_unit(table(spark, sf_dir, "embeddings"), "embedding").select(F.col("vec_id").alias("id"), F.col("unit").alias("vec"))
    unit = materialize(unit, "unit")
    return align.top2(unit, unit)


@query(f"with {TOP2} select id, best_id, second_id, round(second_sim, 6) as second_sim from t2")
def align_top1(spark, sf_dir):
    return _top2(spark, sf_dir).select("id", "best_id", "second_id", F.round("second_sim", 6).alias("second_sim"))


@query(f"with {TOP2}, m as (select best_sim - second_sim as margin from t2) select count(*) as n, round(avg(margin), 6) as mean, round(quantile_cont(margin, 0.5), 6) as median, round(quantile_cont(margin, 0.9), 6) as p90 from m")
def align_margin_stats(spark, sf_dir):
    s = align.margin_stats(_top2(spark, sf_dir).select((F.col("best_sim") - F.col("second_sim")).alias("margin")))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p90")])


@query(f"""with {TOP2}, ids as (select vec_id as id from embeddings union all select -1 - page_id from pages),
    g as (select ids.id, case when label <> 0 then label::bigint end as gold, vec_id is not null as known from ids left join embeddings on vec_id = ids.id)
    select g.id as tgt_id, case when gold is not null then gold when not known then ('0x' || substr(md5('0:' || g.id), 1, 8))::bigint % (select count(*) from embeddings) when best_id = 0 then second_id else best_id end as src_id,
    case when gold is not null then 'gold' when not known then 'random' else 'query' end as method, case when gold is null and known then round(best_sim - second_sim, 6) end as margin from g left join t2 on t2.id = g.id""")
def align_cascade(spark, sf_dir):
    """Gold where a label is known, hash-drawn for ids without a vector (made of the pages' ids), else the best or, behind the unknown id 0, second best inner product."""
    rows = table(spark, sf_dir, "embeddings")
    gold = rows.where("label <> 0").select(F.col("vec_id").alias("tgt_id"), F.col("label").cast("long").alias("src_id"))
    vectors = materialize(align.with_unit(rows, "embedding").select(F.col("vec_id").alias("id"), F.col("unit").alias("vec")), "cascade-vectors")
    bare = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"))
    return align.align(vectors.select("id").union(bare), gold, vectors, vectors, rows.count(), unknown=0).withColumn("margin", F.round("margin", 6))


@query(f"select a.vec_id as tgt_id, b.vec_id as src_id, {digest_sql('b.embedding')} as digest from embeddings a join embeddings b on b.vec_id = a.label")
def gather_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    g = align.gather_rows(rows.select(F.col("vec_id").alias("tgt_id"), F.col("label").cast("long").alias("src_id")), rows.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec")))
    return g.select("tgt_id", "src_id", digest("vec").alias("digest"))


@query("select label as src_id, min(vec_id) as tgt_id from embeddings group by label")
def invert_map(spark, sf_dir):
    return align.invert(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tgt_id"), F.col("label").alias("src_id")))


# Statistics


@query(f"""with x as (select (row_number() over (order by doc_id) - 1)::bigint as i, (toxic - quality)::double as d from labels), c as (select count(*) as n from x),
    g as (select r // n as b, ('0x' || substr(md5('{SEED}:' || r), 1, 12))::bigint % n as i from c, lateral (select unnest(range(0, {SAMPLES} * n)) as r)),
    s as (select b, sum(d) / any_value(n) as d from g join x using (i), c group by b),
    o as (select list_sort(list(d)) as s, avg((d <= 0)::int) as le, avg((d >= 0)::int) as ge from s)
    select round((select sum(d) / count(*) from x), 9) as delta_mean, round(s[{int(0.025 * (SAMPLES - 1)) + 1}], 9) as ci_low, round(s[{int(0.975 * (SAMPLES - 1)) + 1}], 9) as ci_high, round(least(1.0, 2 * least(le, ge)), 9) as p_value_two_sided from o""")
def bootstrap_diff(spark, sf_dir):
    s = metrics.bootstrap(table(spark, sf_dir, "labels"), "quality", "toxic", "doc_id", SAMPLES, SEED)
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query(f"with {PREDICTED}, n as (select dataset as metric, avg((pred = label)::int) as value from p group by dataset), o as (select dataset as metric, avg(quality) as baseline from p group by dataset) select metric, round(value, 9) as value, round(baseline, 9) as baseline, round(value - baseline, 9) as delta from n join o using (metric)")
def baseline_delta(spark, sf_dir):
    p = _predicted(spark, sf_dir)
    now = metrics.accuracy(p, "dataset").select(F.col("dataset").alias("metric"), F.col("accuracy").alias("value"))
    d = metrics.baseline_delta(now, p.groupBy(F.col("dataset").alias("metric")).agg(F.avg("quality").alias("value")))
    return d.select("metric", *[F.round(c, 9).alias(c) for c in ("value", "baseline", "delta")])


# Prompts

EXAM_SQL = "'You are a medical exam assistant. Choose A, B, C, or D and justify briefly.' || chr(10) || 'Question: ' || p_name || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || p_type || chr(10) || 'C) ' || p_name || chr(10) || 'D) ' || p_size || chr(10) || 'Answer (just the letter): '"
#: Letters, indexes, an option's text with other spacing and case, and nothing known.
ANSWER_SQL = "case p_partkey % 5 when 0 then ' c' when 1 then p_size::varchar when 2 then '  ' || lower(p_type) || '. ' when 3 then 'D' else 'none' end"
INDEX_SQL = "case when {a} in ('A', 'B', 'C', 'D') then {a} when {a} in ('0', '1', '2', '3') then 'ABCD'[{a}::int + 1] when {a} = '4' then 'D' else {{}} end".format(a=f"upper(trim({ANSWER_SQL}))")


def _part(spark, sf_dir):
    answer = F.expr("case p_partkey % 5 when 0 then ' c' when 1 then cast(p_size as string) when 2 then '  ' || lower(p_type) || '. ' when 3 then 'D' else 'none' end")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_brand").alias("option_a"), F.col("p_type").alias("option_b"), F.col("p_name").alias("option_c"), F.col("p_size").cast("string").alias("option_d"), answer.alias("answer"), F.col("p_type").alias("subject"))


@query(f"select p_partkey, {EXAM_SQL} as prompt, {INDEX_SQL.format('case when p_partkey % 5 = 2 then ' + chr(39) + 'B' + chr(39) + ' when p_partkey % 5 = 1 then case when p_size::varchar = p_type then ' + chr(39) + 'B' + chr(39) + ' else ' + chr(39) + 'D' + chr(39) + ' end else ' + chr(39) * 2 + ' end')} as gold from part")
def mcq_prompt(spark, sf_dir):
    return prompts.medqa(_part(spark, sf_dir)).select("p_partkey", "prompt", "gold")


@query(f"select p_partkey, {EXAM_SQL} as prompt, {INDEX_SQL.format(chr(39) * 2)} as gold from part")
def medmcqa_prompt(spark, sf_dir):
    return prompts.medmcqa(_part(spark, sf_dir)).select("p_partkey", "prompt", "gold")


@query(f"select p_partkey, {EXAM_SQL} as prompt, {INDEX_SQL.format(chr(39) * 2)} as gold from part")
def mmlu_prompt(spark, sf_dir):
    rows = _part(spark, sf_dir).withColumn("choices", F.array("option_a", "option_b", "option_c", "option_d"))
    return prompts.mmlu(rows).select("p_partkey", "prompt", "gold")


@query("select p_partkey, p_type as subject from part where lower(p_type) in ('economy', 'small')")
def mmlu_subject_filter(spark, sf_dir):
    return prompts.subjects(_part(spark, sf_dir), ["Economy", "SMALL"]).select("p_partkey", "subject")


@query("select item_id, 'You are a medical QA assistant. Answer yes/no/maybe.' || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: item ' || item_id || chr(10) || 'Answer: ' as prompt, case item_id % 3 when 0 then 'yes' when 1 then 'no' else '' end as gold from benchmark")
def pubmedqa_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("context"), F.concat(F.lit("item "), "item_id").alias("question"), F.expr("case item_id % 3 when 0 then ' Yes' when 1 then '' end").alias("final_decision"), F.expr("case when item_id % 3 = 1 then 'NO ' end").alias("answer"))
    return prompts.pubmedqa(rows).select("item_id", "prompt", "gold")


@query("select conv_id, turn, 'You are a clinical NLI assistant. Predict entailment, contradiction, or neutral.' || chr(10) || 'Premise: ' || text || chr(10) || 'Hypothesis: ' || role || chr(10) || 'Label: ' as prompt, role as gold from conversations")
def nli_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("premise"), F.col("role").alias("hypothesis"), F.col("role").alias("label"))
    return prompts.mednli(rows).select("conv_id", "turn", "prompt", "gold")


@query("select item_id, 'Extract all Disease entities from the text. One per line, no bullets, exact surface forms.' || chr(10) || 'Text: ' || text || chr(10) || 'Entities:' || chr(10) as prompt from benchmark")
def ner_prompt(spark, sf_dir):
    return prompts.ner(table(spark, sf_dir, "benchmark")).select("item_id", "prompt")


# Tokens


def _tokenizer(spark, name: str = "byte_bpe_50k.json"):
    import public_tokenizers

    return tokens.tokenizer_file(spark, public_tokenizers.path(name))


# Events


@query("""with l as (select *, lag(value) over w as b, lag(ts) over w as t from events window w as (partition by user_id order by ts, event_id)),
    r as (select event_id, greatest(0.0, (value - b) / greatest(0.001, epoch_us(ts) / 1e6::double - epoch_us(t) / 1e6::double)) as rate, greatest(0.0, 1000.0 - value) as remaining from l where b is not null)
    select event_id, round(rate, 4) as rate, round(remaining, 4) as remaining from r""")
def progress_rate_eta(spark, sf_dir):
    p = events.progress(table(spark, sf_dir, "events"), "user_id", "ts", "value", 1000, "event_id").where("rate is not null")
    return p.select("event_id", F.round("rate", 4).alias("rate"), F.round("remaining", 4).alias("remaining"))


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is null or b <> event_type")
def suppress_repeats(spark, sf_dir):
    return events.changed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("select event_id, user_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5")
def tail_n(spark, sf_dir):
    return events.tail(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5).select("event_id", "user_id")


TUMBLING = "select time_bucket(interval '15 seconds', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1"


@query(TUMBLING)
def tumbling_progress(spark, sf_dir):
    return events.tumbling(table(spark, sf_dir, "events"), "ts", WINDOW_S, "value").withColumn("total", F.round("total", 4))


@query("select user_id, round(sum(value) / greatest(0.001, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double), 6) as per_s from events group by user_id")
def throughput(spark, sf_dir):
    return events.throughput(table(spark, sf_dir, "events"), "user_id", "ts", "value").withColumn("per_s", F.round("per_s", 6))


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 minute")


@query(TUMBLING)
def stream_tumbling(spark, sf_dir):
    out = shared_path(spark, "stream-tumbling")
    totals = incremental.tumbling_totals(_event_stream(spark, sf_dir), "ts", WINDOW_S, "value")
    totals.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(f"with {hashed_sql('x', docs_sql())} select doc_id, h from (select *, row_number() over (partition by h order by doc_id % 5, doc_id) as n from x) where n = 1")
def stream_dedup(spark, sf_dir):
    """Five batches, each of as many files as it takes: every batch meets the hashes that the ones before it stored."""
    out = shared_path(spark, "stream-dedup")
    docs = table(spark, sf_dir, "documents")
    for i in range(5):  # each run takes the files that came since the one before
        docs.where(F.col("doc_id") % 5 == i).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{out}/in")
        incremental.dedup_into(stream, f"{out}/store", f"{out}/rows", f"{out}/state", "doc_id").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("doc_id", "h")
