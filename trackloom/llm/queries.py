"""Queries over the text tables: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, collocations, exact_dedup, lm_score, minhash, mixing, negatives, packing, pii, quality, sharding, token_counts, toxicity

#: Where the rank file of the byte-level vocabulary lies, and the pattern that splits texts for it.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), k=3, percent=85)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_documents(spark, sf_dir), RANKS, PATTERN, decoded=True)
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_documents(spark, sf_dir), 16)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.backoff_scores(_documents(spark, sf_dir), order=3)
    return scored.select("doc_id", "n_words", "n_seen", *[F.round(c, 3).alias(c) for c in ("log_score", "mean_log_score", "seen_share")])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir), [5, 2, 1], 3)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir))
    base = pii.listed({k: F.col(f"base_{k}") for k in pii.KINDS})
    every = pii.listed({k: F.concat(f"base_{k}", f"added_{k}") for k in pii.KINDS})
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), RANKS, PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, every=100, positives=5, negatives=5, low=0.8, high=1.0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir), least=100, longest=5, top=2000)


QUERIES = {
    "op2_byte_bpe": op2_byte_bpe,
    "op3_sharding": op3_sharding,
    "op8_pii": op8_pii,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op11_packing": op11_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op4_lm_scoring": r"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
        p as (select r, generate_subscripts(ws, 1) as i, unnest(ws) as w1 from d),
        g as (select r, i, w1, lag(w1) over o as w2, lag(w1, 2) over o as w3 from p window o as (partition by r order by i)),
        c as (select r, i, count(*) over (partition by w1) - count(*) over (partition by r, w1) as c1,
                     case when i >= 2 then count(*) over (partition by w2, w1) - count(*) over (partition by r, w2, w1) end as c2,
                     case when i >= 3 then count(*) over (partition by w3, w2, w1) - count(*) over (partition by r, w3, w2, w1) end as c3 from g),
        x as (select *, lag(c1) over o as b1, lag(c2) over o as b2 from c window o as (partition by r order by i)),
        s as (select r, count(*) as n_words, sum(case when i >= 3 then c3 >= 1 when i = 2 then c2 >= 1 else c1 >= 1 end) as n_seen,
                     sum(case when c3 >= 1 then ln(c3::double / b2) when c2 >= 1 then ln(c2::double / b1) + case when i >= 3 then ln(0.4::double) else 0 end
                              else ln(greatest(c1, 1)::double / (select count(*) from p)) + (least(i, 3) - 1) * ln(0.4::double) end) as log_score from x group by r)
        select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_seen, 0)::bigint as n_seen, round(coalesce(log_score, 0), 3) as log_score,
               round(log_score / n_words, 3) as mean_log_score, round(n_seen::double / n_words, 3) as seen_share
        from d left join s using (r)
    """,
    "op5_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
        from t window w as (partition by t)
    """,
    "op7_mixing": r"""
        with docs as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                   coalesce(case when length(text) > 0 then 0.1::double + 0.9::double * length(translate(text, '0123456789#*$%&|<>{}[]=_\/@', '')) / length(text) end, 0.1::double) as q,
                   (('0x' || substr(sha256(coalesce(doc_id::varchar, 'null:' || sha256(coalesce(text, ''))) || chr(31) || 'mix'), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double as u
            from documents),
        keyed as (select *, -ln(u) / q as k from docs),
        s as (select source, sum(size)::bigint as source_size, list_value(5.0, 2.0, 1.0)[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w
              from docs group by source),
        lv as (select *, 3.0::double * source_size as cap,
                      ((sum(source_size) over ())::double - coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
                      / sum(w) over (order by 3.0::double * source_size / w, source nulls last rows between current row and unbounded following) as level
               from s),
        t as (select source, source_size, least(cap, coalesce((select arg_min(level, cap / w) from lv where cap >= level * w) * w, cap)) as target from lv),
        plan as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
        b as (select *, round(target - epochs * source_size)::bigint as budget from plan),
        r as (select d.*, b.source_size, b.target, b.epochs, b.budget,
                     coalesce(sum(d.size) over (partition by d.source order by k, doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as start
              from keyed d join b on d.source is not distinct from b.source),
        p as (select *, greatest(0, least(size, budget - start))::bigint as part from r)
        select doc_id, size, source_size, target, (epochs * size + part)::bigint as taken, epochs + (part > 0)::bigint as copies from p
    """,
    "op12_hard_negatives": r"""
        with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
                   from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as a, r.vec_id as i, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as s
              from r a join r on a.vec_id <> r.vec_id and len(a.v) = len(r.v) where a.vec_id % 100 = 0),
        p as (select a, i, s from (select *, row_number() over (partition by a order by s desc, i) as k from s where same) where k <= 5),
        n as (select p.a as anchor_id, p.i as positive_id, row_number() over (partition by p.a, p.i order by s.s desc, s.i)::int as rank, s.i as negative_id, p.s as positive_score, s.s as negative_score
              from p join s on p.a = s.a and not s.same and 80 * p.s <= 100 * s.s and 100 * s.s <= 100 * p.s)
        select * from n where rank <= 5
    """,
    "op13_collocations": r"""
        with d as (select row_number() over () as d, coalesce(lang, 'und') as lang,
                          string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as ps from documents),
        p as (select d, lang, generate_subscripts(ps, 1) as p, unnest(ps) as piece from d),
        q as (select d, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
        w as (select d, lang, p, generate_subscripts(ws, 1) as i, unnest(ws) as w1 from q),
        g as (select lang, w1, lead(w1) over o as w2, lead(w1, 2) over o as w3, lead(w1, 3) over o as w4, lead(w1, 4) over o as w5 from w window o as (partition by d, p order by i)),
        n as (select lang, count(*) as n from w group by lang),
        f as (select lang, 1 as k, [w1] as ws, count(*) as c from g group by lang, w1 having count(*) >= 100
              union all select lang, 2, [w1, w2], count(*) from g where w2 is not null group by lang, w1, w2 having count(*) >= 100
              union all select lang, 3, [w1, w2, w3], count(*) from g where w3 is not null group by lang, w1, w2, w3 having count(*) >= 100
              union all select lang, 4, [w1, w2, w3, w4], count(*) from g where w4 is not null group by lang, w1, w2, w3, w4 having count(*) >= 100
              union all select lang, 5, [w1, w2, w3, w4, w5], count(*) from g where w5 is not null group by lang, w1, w2, w3, w4, w5 having count(*) >= 100),
        inside as (select distinct lang, ws[i:i + m - 1] as ws, c from (select lang, ws, c, m, unnest(generate_series(1, k - m + 1)) as i
                   from (select *, unnest(generate_series(2, k - 1)) as m from f where k > 2))),
        c as (select f.* from f where k >= 2 and not exists (select 1 from inside x where x.lang = f.lang and x.ws = f.ws and x.c >= f.c)),
        cut as (select c.lang, c.ws, c.c as a, j, l.c as l, r.c as r, n.n, (1000::hugeint * c.c * n.n // (l.c::hugeint * r.c))::bigint as score
                from (select *, unnest(generate_series(1, k - 1)) as j from c) c join f l on l.lang = c.lang and l.ws = c.ws[1:j] join f r on r.lang = c.lang and r.ws = c.ws[j + 1:] join n on n.lang = c.lang),
        best as (select * from cut qualify row_number() over (partition by lang, ws order by score, j) = 1)
        select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(ws, ' ')) as rank, array_to_string(ws, ' ') as phrase, a, l, r, n, score
        from best qualify rank <= 2000
    """,
}
