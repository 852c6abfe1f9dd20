"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table_path
from .fingerprints import fingerprint_edits
from .langid import fit, fold_of, identify
from .line_dedup import dedup_lines
from .media import clip_digests, store_clips
from .mixing import mix_sources
from .ngram_join import link_documents
from .packing import pack, token_pieces
from .prefix_trie import conversation_trie
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .token_store import read_digests, write_store
from .transducer import decode, encode
from .vector_codes import compress


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("removed"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), counts=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(_documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_documents(spark, sf_dir))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-store")
    write_store(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, path)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    clips = store_clips(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    return clip_digests(clips)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("word_bpe_49k.json")
    back = decode(encode(_documents(spark, sf_dir).select("doc_id", "text"), model), model)
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return back.select("doc_id", "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_join": op6_ngram_join,
    "op7_fingerprints": op7_fingerprints,
    "op8_token_store": op8_token_store,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_media_columns": op10_media_columns,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_bpe_codec": op13_bpe_codec,
}

#: Words of lower-cased texts in DuckDB's dialect: only A to Z change, only the six ASCII spaces part.
_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    # every 400-byte window by its bytes; runs of covered bytes; what is left between them
    "op2_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), n as (select doc_id, h, length(h) // 2 as n from d),
        w as (select doc_id, unnest(range(0, n - 399)) as p from n where n >= 400), m as (select w.doc_id, p, md5(substr(h, 2 * p + 1, 800)) as k from w join n using (doc_id)),
        r as (select doc_id, p from m qualify count(*) over (partition by k) > 1), b as (select *, case when p <= lag(p) over (partition by doc_id order by p) + 400 then 0 else 1 end as new from r),
        i as (select *, sum(new) over (partition by doc_id order by p rows unbounded preceding) as run from b), s as (select doc_id, run, min(p) as a, max(p) + 400 as z from i group by 1, 2),
        g as (select n.doc_id, coalesce(lag(s.z) over (partition by n.doc_id order by s.a), 0) as a, s.a as z from n join s using (doc_id) union all select n.doc_id, coalesce(max(s.z), 0), max(n.n) from n left join s using (doc_id) group by 1),
        k as (select g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' order by a) as kept from g join n using (doc_id) group by 1), t as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans from s group by 1)
        select n.doc_id, cast(n.n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(kept)) as kept_sha256, n_removed is not null as removed from n join k using (doc_id) left join t using (doc_id)""",
    # rarest words first; two alike sets share one of the words that each shows
    "op4_line_dedup": f"""
        with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents where text is not null), w as (select doc_id, k, line, list_sort(list_distinct({_WORDS.format("line")})) as ws from l),
        c as (select ws, min((doc_id, k)) as first from w where len(ws) > 0 group by 1), e as (select ws, first, unnest(ws) as word from c), f as (select word, count(*) as n from e group by 1),
        o as (select ws, first, word, row_number() over (partition by ws order by f.n, word) as k from e join f using (word)), s as (select * from o where k <= len(ws) - (8 * len(ws) + 9) // 10 + 1),
        p as (select distinct a.ws as x, b.ws as y from s a join s b on a.word = b.word and b.first < a.first and 10 * len(a.ws) >= 8 * len(b.ws) and 10 * len(b.ws) >= 8 * len(a.ws)),
        gone as (select distinct x as ws from (select x, len(x) as n, len(y) as m, len(list_intersect(x, y)) as common from p) where 10 * common >= 8 * (n + m - common)),
        t as (select w.doc_id, w.k, w.line, len(w.ws) > 0 and (gone.ws is not null or (w.doc_id, w.k) <> c.first) as out from w left join c on c.ws = w.ws left join gone on gone.ws = w.ws),
        g as (select doc_id, string_agg(line, chr(10) order by k) filter (where not coalesce(out, false)) as kept, count(*) as n_lines, count(*) filter (where out) as n_removed from t group by 1)
        select d.doc_id, case when d.text is not null then coalesce(kept, '') end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed from documents d left join g using (doc_id)""",
    # all pairs that share a shingle
    "op6_ngram_join": f"""
        with recursive w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
        i as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0), s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g from i),
        n as (select doc_id, count(*) as n from s group by 1), b as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        l as (select x, y from b join n p on p.doc_id = x join n q on q.doc_id = y where 100 * common >= 85 * (p.n + q.n - common)), r as (select doc_id as x, doc_id as y from documents union select r.x, l.y from r join l on l.x = r.y)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, r.low as component_id from documents d left join n using (doc_id) join (select x, min(y) as low from r group by 1) r on r.x = d.doc_id""",
    # every beginning of every conversation as text, 64 letters a turn; crc32 bit by bit
    "op11_prefix_trie": """
        with t as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
        n as (select conv_id, turn, sha256(strlen(r) || ':' || r || x) as name, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as words from t), s as (select conv_id, list(name order by turn nulls first, name) as own, list(words order by turn nulls first, name) as w from n group by 1),
        c as (select *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda d: list_prepend(cast(ascii(d) as bigint), [0, 0, 0, 0, 0, 0, 0])))), lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) % 4 as h from s),
        b as (select c.conv_id, list_concat(coalesce(l.own[1:c.h], []), c.own[c.h + 1:]) as q, list_concat(coalesce(l.w[1:c.h], []), c.w[c.h + 1:]) as w from c left join s l on l.conv_id = c.conv_id - c.conv_id % 20),
        e as (select conv_id, array_to_string(q, '') as q, w, unnest(range(0, len(q) + 1)) as d from b),
        v as (select left(q, 64 * d) as p, d, min(conv_id) as conv_id, count(*) as n_convs, max(case when d > 0 then w[d] else 0 end) as w, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where length(q) = 64 * d), '')) as ends from e group by 1, 2),
        k as (select left(p, 64 * (d - 1)) as p, count(*) as n_children from v where d > 0 group by 1), o as (select v.*, coalesce(n_children, 0) as n_children from v left join k using (p)),
        u as (select left(p, 64 * unnest(range(0, d + 1))) as p, case when n_children = 0 then 1 else 0 end as leaf, (n_convs - 1) * w as saved from o), g as (select p, sum(leaf) as n_leaves, sum(saved) as saved_tokens from u group by 1)
        select o.conv_id, cast(o.d as bigint) as depth, z.conv_id as parent_conv_id, o.n_convs, o.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, o.ends as ends_sha256
        from o join g using (p) left join o z on o.d > 0 and z.d = o.d - 1 and z.p = left(o.p, 64 * (o.d - 1))""",
    # every distance to every entry
    "op12_vector_codes": """
        with w as (select row_number() over (order by vec_id nulls last, embedding) as k, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), g as (select k, q, unnest(range(0, 16)) as part from w), v as (select k, part, q[part * (len(q) // 16) + 1:(part + 1) * (len(q) // 16)] as x from g),
        c0 as (select part, cast(k - 1 as int) as i, x as e from v where k <= 64), a1 as (select k, part, x, i, d from (select v.k, v.part, v.x, c.i, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i]))) as d from v join c0 c using (part)) qualify row_number() over (partition by k, part order by d, i) = 1),
        s1 as (select part, i, list(cast(floor_div as bigint) order by j) as e from (select part, i, j, case when s >= 0 then s // n else -((-s + n - 1) // n) end as floor_div from (select part, i, j, sum(x[j]) as s, count(*) as n from (select part, i, x, unnest(range(1, len(x) + 1)) as j from a1) group by 1, 2, 3)) group by 1, 2), c1 as (select c.part, c.i, coalesce(s.e, c.e) as e from c0 c left join s1 s on s.part = c.part and s.i = c.i),
        a2 as (select k, part, x, i, d from (select v.k, v.part, v.x, c.i, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i]))) as d from v join c1 c using (part)) qualify row_number() over (partition by k, part order by d, i) = 1), s2 as (select part, i, list(cast(floor_div as bigint) order by j) as e from (select part, i, j, case when s >= 0 then s // n else -((-s + n - 1) // n) end as floor_div from (select part, i, j, sum(x[j]) as s, count(*) as n from (select part, i, x, unnest(range(1, len(x) + 1)) as j from a2) group by 1, 2, 3)) group by 1, 2), c2 as (select c.part, c.i, coalesce(s.e, c.e) as e from c1 c left join s2 s on s.part = c.part and s.i = c.i),
        a3 as (select k, part, x, i, d from (select v.k, v.part, v.x, c.i, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i]))) as d from v join c2 c using (part)) qualify row_number() over (partition by k, part order by d, i) = 1),
        r as (select k, string_agg(printf('%02x', i), '' order by part) as code, cast(sum(d) as bigint) as error from a3 group by 1),
        h as (select sha256(string_agg(array_to_string(e, ','), ',' order by part, i)) as codebooks_sha256 from c2)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from w join r using (k), h""",
}
