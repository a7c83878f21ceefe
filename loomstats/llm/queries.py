"""The catalog of the corpus operators: one query each over its whole table, and checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loomstats.llm import (
    chat, credentials, decontaminate, mixing, neardup, passages, quality, setjoin, spelling, tokens, toxicity, warc, whitening,
)
from loomstats.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; one row per document."""
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP1_SQL = """
with d as (
  select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents
), s as (
  select source, sum(size) as source_size from d group by source
), w as (
  select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, 2 * source_size as cap from s
), r as (
  select *, (3 * sum(source_size) over ()
             - 2 * coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            * weight
            > 2 * cap * sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following)
            as capped
  from w
), t as (
  select source, source_size, case when capped then cap::double else
    (weight * (3 * sum(source_size) over () - 2 * coalesce(sum(case when capped then cap end) over (), 0)))::double
    / (2 * sum(case when not capped then weight end) over ())::double end as target
  from r
), e as (
  select *, case when source_size > 0 then floor(target * 16777216 / source_size)::bigint else 0 end as expected,
         ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 6))::bigint as shift
  from t
), u as (
  select doc_id, source, md5(text) as digest, size, count(*) as n, md5(coalesce(doc_id::varchar, '')) as tie
  from d group by all
), p as (
  select u.doc_id, u.size, u.n, e.source_size, e.target, e.expected,
         e.shift + sum(e.expected) over (partition by u.source order by u.size, u.tie, u.doc_id, u.digest
                                         rows between unbounded preceding and current row) as top
  from u join e on u.source is not distinct from e.source
), c as (
  select *, (top // 16777216 - (top - expected) // 16777216)::bigint as copies from p
)
select doc_id, size::bigint as size, source_size::bigint as source_size, target, (copies * size)::bigint as taken, copies
from c, range(n)
"""


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the files, read them back."""
    return tokens.encode_documents(spark, table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and the one of control strings; digests of what is read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(chat.extra_conversation(rows))
    back = chat.read_back(chat.write(chat.canonical_turns(chat.pack(rows))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(lost).cast("long").alias("loss_chars"), F.sha2(lost.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = """
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e as (
  select *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') as x, regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g') as y from r
), a as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
         coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as lost,
         sum(len('<|im_start|>' || replace(y, chr(10), '<|n') || chr(10) || x || '<|im_end|>' || chr(10))) as formatted_chars
  from e group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, len(lost)::bigint as loss_chars, sha256(lost) as loss_sha256,
       formatted_chars::bigint as formatted_chars
from a
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "_doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that repeat in other documents."""
    return passages.repeats(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents."""
    return credentials.scan(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search all benchmark phrases in all documents."""
    rows = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return rows.select(
        "_doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = """
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), b as (
  select coalesce(item_id::varchar, 'null') as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), p as (
  select distinct item, least(10, len(w)) as n,
         array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as phrase
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), d as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from w, (select distinct n from p) where len(w) >= n)
), h as (select d.doc_id, d.i, d.n, p.item from d join p on d.phrase = p.phrase and d.n = p.n
), c as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id
), t as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from h) group by doc_id
)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join c using (doc_id) left join t using (doc_id)
"""


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, read them back."""
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


OP8_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages
), q as (select page_id, octet_length(payload) as n, sha1(payload) as d, sha256(payload) as k from p
), g as (select k, n, max(page_id) as first from q where n >= 1000 group by k, n
)
select q.page_id, q.n::bigint as payload_bytes, q.d as payload_digest,
       case when g.first <> q.page_id then 'revisit' else 'response' end as record_type,
       case when g.first <> q.page_id then g.first end as refers_to
from q left join g on q.k = g.k and q.n = g.n
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join all documents with each other; one row per document."""
    return setjoin.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


OP10_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) >= 4 then [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]
                                    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w
), n as (select doc_id, len(s) as n from s
), e as (select doc_id, unnest(s) as g from s
), o as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all
), l as (
  select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)
), r as (
  select doc_id, doc_id as c from n union select r.doc_id, l.b from r join l on r.c = l.a
)
select n.doc_id, n.n::bigint as n_shingles, min(r.c) as component_id,
       (select count(*) from l where l.a = n.doc_id) as n_links
from n join r on n.doc_id = r.doc_id group by n.doc_id, n.n
"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings of a label."""
    return neardup.link_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
with recursive e as (
  select vec_id, label, embedding::double[] as v, row_number() over () as r from embeddings
), g as (
  select * from e where label is not null and len(list_filter(v, lambda c: c is null or not isfinite(c))) = 0
                    and len(list_filter(v, lambda c: c <> 0)) > 0
), l as (
  select a.r as a, b.r as b from g a join g b
  on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r and list_cosine_similarity(a.v, b.v) >= 0.93
), c as (
  select r, r as other from e union select c.r, l.b from c join l on c.other = l.a
)
select e.vec_id, (select count(*) from l where l.a = e.r) as n_links, min(o.vec_id) as component_id,
       e.vec_id = min(o.vec_id) as kept
from e join c using (r) join e o on o.r = c.other group by e.r, e.vec_id
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


OP13_SQL = """
with recursive t as (
  select list(v order by i) as crc from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from (select unnest(range(256)) as i))
), d as (
  select coalesce(doc_id::varchar, '') as doc_id,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
), r as (select doc_id, run, count(*) as n from d where len(run) >= 7 group by all
), b as (select *, hex(encode(doc_id || ':' || run)) as x from r
), h as (
  select run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295, [('0x' || x[2 * i + 1:2 * i + 2])::bigint for i in range(len(x) // 2)]),
           lambda c, y: xor(c >> 8, crc[xor(c & 255, y) + 1]))) as h
  from b, t
), w as (
  select case when h % 31 = 0 then run[1:h % len(run)] || run[h % len(run) + 2:] else run end as word, n from h
), v as (select word, sum(n)::bigint as n from w where len(word) >= 7 group by word having sum(n) >= 2
), k as (
  select distinct word, n, i, word[1:i] || word[i + 2:] as less from (select word, n, unnest(range(len(word))) as i from v)
), p as (
  select a.word, b.word as near, b.n from k a join k b on a.less = b.less and a.i = b.i and a.word <> b.word
  union select k.word, v.word, v.n from k join v on k.less = v.word
  union select v.word, k.word, k.n from k join v on k.less = v.word
), q as (
  select word, count(*) as n_near, max(n) as most, arg_min(near, (-n, near)) as best from p group by word
), f as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when most >= 10 * v.n then best end as form,
         case when most >= 10 * v.n then most end as form_n
  from v left join q using (word)
), c as (
  select word, word as root, 0 as depth from f
  union all select c.word, f.form, depth + 1 from c join f on c.root = f.word where f.form is not null
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n
from f join (select word, arg_max(root, depth) as root from c group by word) r using (word)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources, "op2_token_files": op2_token_files, "op3_chat_format": op3_chat_format, "op4_quality_rules": op4_quality_rules,
        "op5_substring_dedup": op5_substring_dedup, "op6_secret_scan": op6_secret_scan, "op7_benchmark_decontamination": op7_benchmark_decontamination, "op8_warc_archives": op8_warc_archives, "op9_toxicity": op9_toxicity, "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_embedding_whitening": op11_embedding_whitening, "op12_embedding_near_dedup": op12_embedding_near_dedup,
        "op13_spelling_variants": op13_spelling_variants, "pipeline": pipeline,
    }


def oracles() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1_SQL, "op3_chat_format": OP3_SQL, "op7_benchmark_decontamination": OP7_SQL,
        "op8_warc_archives": OP8_SQL, "op10_ngram_jaccard_join": OP10_SQL,
        "op12_embedding_near_dedup": OP12_SQL, "op13_spelling_variants": OP13_SQL,
    }
