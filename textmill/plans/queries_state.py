"""Queries of stores and states: seen hashes by buckets, a bounded cache of recent keys, a build that stops reading, resampling by blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import sql as sql_functions
from textmill.operators import dedup, metrics, staged
from textmill.operators.budget import Build
from textmill.operators.store import SeenStore
from textmill.plans.queries import SAMPLES, SEED, _build_sql, _targets, docs_sql, hashed_sql, pieces_sql, words_sql
from textmill.plans.registry import query, table
from textmill.plans.shared import materialize, shared_path
from textmill.sources import readers
from textmill.streaming import recent


@query(f"with {hashed_sql('x', docs_sql())} select doc_id, h from x where source not in ('src0', 'src1', 'src2') and h not in (select h from x where source in ('src0', 'src1', 'src2'))")
def seen_store_segments(spark, sf_dir):
    """A store of three segments, one of them written twice, two of them compacted; then what it lacks."""
    rows = materialize(dedup.hashed(table(spark, sf_dir, "documents")).select("doc_id", "source", "h"), "store-rows")
    store = SeenStore(spark, shared_path(spark, "seen-store"))
    own = lambda i: rows.where(F.col("source") == f"src{i}")
    store.add(own(0), 0)
    store.add(own(3), 1)
    store.add(store.without(own(1), but=1), 1)
    store.compact(before=2)
    store.add(store.without(own(2), but=2), 2)
    return store.without(rows.where("source not in ('src0', 'src1', 'src2')")).select("doc_id", "h")


BOUND, AGE_DAYS, SHARDS = 12, 2, 8


@query(f"""with recursive e as (select event_id, u, t, shard, row_number() over (partition by shard order by t, event_id) as n
        from (select event_id, user_id::varchar as u, epoch_us(ts) as t, ('0x' || substr(md5(user_id::varchar), 1, 8))::bigint % {SHARDS} as shard from events)),
    s(shard, n, event_id, u, fresh, state) as (select shard, 0::bigint, null::bigint, null::varchar, false, []::struct(u varchar, t bigint)[] from (select distinct shard from e)
        union all select shard, n, event_id, u, not held, case when held then c else list_append(c, {{'u': u, 't': t}})[-{BOUND}:] end
        from (select *, list_contains(list_transform(c, lambda x: x.u), u) as held from
            (select e.*, list_filter(s.state, lambda x: x.t >= e.t - {AGE_DAYS * 86_400_000_000}) as c from s join e on e.shard = s.shard and e.n = s.n + 1)))
    select event_id, u as user, shard, len(state)::int as held from s where fresh""")
def stream_bounded_recent(spark, sf_dir):
    """The first event of each user that isn't among its shard's last twelve, of two days: four runs over files in the order of their times."""
    out = shared_path(spark, "bounded-recent")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user"), "ts")
    cuts = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    part = F.least(F.lit(3), F.floor(4 * (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp")) + 1)))
    dealt = materialize(rows.crossJoin(F.broadcast(cuts)).select(*rows.columns, part.cast("int").alias("part")), "recent-parts")  # one row beside each
    for i in range(4):
        dealt.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{out}/in")
        once = recent.first_recent(stream, "user", "ts", "event_id", BOUND, AGE_DAYS * 86_400, SHARDS)
        once.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/out")


@query(f"with {_build_sql()} select source, doc_id as doc_ord, chunk_ix, h, nbytes::bigint as nbytes from built")
def corpus_build_staged(spark, sf_dir):
    """The corpus build from files in the order of their ids, of which it reads no more than its budgets need."""
    path = shared_path(spark, "documents-by-id")
    docs = table(spark, sf_dir, "documents")
    docs.repartitionByRange(16, "source", "doc_id").sortWithinPartitions("source", "doc_id").write.parquet(path)
    built, _, _ = staged.build_staged(spark, path, table(spark, sf_dir, "benchmark"), _targets(spark, Build().target_bytes))
    return built.select("source", "doc_ord", "chunk_ix", "h", "nbytes")


@query()
def bootstrap_blocks(spark, sf_dir):
    """A thousand samples, each of exactly as many draws as there are labelled rows, split over blocks."""
    s = metrics.bootstrap_blocks(table(spark, sf_dir, "labels"), "quality", "toxic", SAMPLES, SEED)
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query()
def folder_bytes(spark, sf_dir):
    """What lies in the tables' folder."""
    return readers.folder_bytes(spark, sf_dir)


@query(f"""with d as {docs_sql()} select doc_id, chunk_ix, n_words, length(piece) as n_chars, md5(piece) as digest
    from (select *, len({words_sql('whole')}) as n_words from ({pieces_sql(900, '(select doc_id, whole from d)')}))""")
def sql_chunks(spark, sf_dir):
    """A query in SQL over the registered functions: normalised texts, their words, and a table function for their pieces."""
    sql_functions.register(spark)
    docs = table(spark, sf_dir, "documents")
    return spark.sql("select doc_id, chunk_ix, n_words, length(piece) as n_chars, md5(cast(piece as binary)) as digest from (select doc_id, norm_text(text) as t, word_count(text) as n_words from {docs}) d, lateral text_chunks(d.t, 900)", docs=docs)


@query(f"with {hashed_sql('x', docs_sql())} select h, count(*) as n, min(doc_id) as first from x group by h having count(*) > 1")
def sql_duplicates(spark, sf_dir):
    """Texts of one hash, by SQL over the registered functions."""
    sql_functions.register(spark)
    return spark.sql("select h, count(*) as n, min(doc_id) as first from (select doc_id, hash_3gram(norm_text(text)) as h from {docs}) group by h having count(*) > 1", docs=table(spark, sf_dir, "documents"))
