"""The registered queries of the subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .collocations import collocations
from .common import remainder, scratch, table
from .decontaminate import contamination
from .imatch import as_text, fingerprints, likeness
from .langid import identify
from .pii import KINDS, listed, personal_data
from .linededup import line_dedup
from .quality import quality
from .ranking import ranked
from .secrets import KINDS as SECRET_KINDS
from .secrets import listed as listed_secrets
from .secrets import secrets
from .simhash import hex_fingerprint, simhash_groups
from .toxicity import toxicity
from .warc import page_of, read_warc, write_warc


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
                      as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                      likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    out = toxicity(docs, docs.where(~held_out), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op4_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    out = identify(docs, docs.where(~held_out).select("text", "lang"))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), vocabulary()).drop("text_key")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), width=3, max_bits=2)
    return groups.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                      F.col("n_removed").cast("long").alias("n_removed"),
                      F.char_length(text).cast("long").alias("n_chars_kept"),
                      F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    of = lambda i: lambda x: x["k"] == i
    return out.select("doc_id", *[F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
                      F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op9_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 5) == 0
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_warc(spark, path).where("kind = 'record'").select(
        page_of(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), page_of(F.col("refers_to"), kind).alias("refers_to"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    of = lambda i: lambda x: x["k"] == i
    return out.select("doc_id", *[F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(SECRET_KINDS)],
                      F.sha2(listed_secrets("base").cast("binary"), 256).alias("base_sha256"), listed_secrets("spans").alias("spans"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def vocabulary() -> str:
    """Place of the production vocabulary file (a public tokenizer that every machine has)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    "op1_imatch": op1_imatch,
    "op8_pii": op8_pii,
    "op9_gam": op9_gam,
    "op10_warc": op10_warc,
    "op2_toxicity": op2_toxicity,
    "op4_rank_order": op4_rank_order,
    "op3_winnowing": op3_winnowing,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_secrets": op12_secrets,
    "op13_ranked": op13_ranked,
}

SQL_OP7 = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
nb as (select doc_id, i, trim(line, ' ' || chr(9) || chr(13)) s,
              row_number() over (partition by doc_id order by i) j
       from l where trim(line, ' ' || chr(9) || chr(13)) <> ''),
w as (select doc_id, j, s || chr(10) || lead(s) over d || chr(10) || lead(s, 2) over d k
      from nb window d as (partition by doc_id order by j)),
r as (select doc_id, j, row_number() over (partition by k order by doc_id, j) n from w where k is not null),
gone as (select distinct doc_id, j + unnest([0, 1, 2]) j from r where n > 1),
out as (select l.doc_id, l.i, l.line, nb.j, g.j is not null dropped
        from l left join nb using (doc_id, i) left join gone g on g.doc_id = nb.doc_id and g.j = nb.j),
agg as (select doc_id, count(*) n_lines, count(*) filter (dropped) n_removed, count(j) n_nb,
               string_agg(line, chr(10) order by i) filter (not dropped) kept from out group by doc_id),
fin as (select doc_id, n_lines, n_removed,
               case when n_removed > 0 and n_removed = n_nb then '' else coalesce(kept, '') end kept from agg)
select doc_id, n_lines, n_removed, length(kept) n_chars_kept, sha256(kept) kept_sha256 from fin
"""

SQL_OP3 = r"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
           from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
      from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') g
       from (select item_id, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from t, ns where len(w) >= n)),
hit as (select doc_id, item_id, i, dw.n from dw join bw using (n, g)),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids
          from (select distinct doc_id, item_id::varchar id from hit) group by doc_id)
select t.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from t left join words using (doc_id) left join items using (doc_id)
"""

SQL_OP11 = r"""
with t as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
p as (select lang, row_number() over () id, regexp_extract_all(p, '[^\x20\x09]+') w from t),
o as (select lang, id, unnest(w) w1, generate_subscripts(w, 1) i from p),
s as (select lang, w1, lead(w1) over d w2, lead(w1, 2) over d w3 from o window d as (partition by id order by i)),
n as (select lang, count(*) n from s group by lang),
f1 as (select lang, w1, count(*) f from s group by all),
f2 as (select lang, w1, w2, count(*) f from s where w2 is not null group by all having count(*) >= 10),
f3 as (select lang, w1, w2, w3, count(*) f from s where w3 is not null group by all having count(*) >= 10),
c3 as (select c.*, x.f la, yz.f ra, xy.f lb, z.f rb,
              (1000000::hugeint * c.f * c.f) // (x.f::hugeint * yz.f) sa, (1000000::hugeint * c.f * c.f) // (xy.f::hugeint * z.f) sb
       from f3 c join f1 x on x.lang = c.lang and x.w1 = c.w1
       join f2 yz on yz.lang = c.lang and yz.w1 = c.w2 and yz.w2 = c.w3
       join f2 xy on xy.lang = c.lang and xy.w1 = c.w1 and xy.w2 = c.w2
       join f1 z on z.lang = c.lang and z.w1 = c.w3),
longer as (select lang, w1, w2, max(f) f from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all),
c as (select lang, w1 || ' ' || w2 || ' ' || w3 phrase, f a, case when sb < sa then lb else la end l,
             case when sb < sa then rb else ra end r, least(sa, sb) score from c3
      union all
      select c.lang, c.w1 || ' ' || c.w2, c.f, x.f, y.f, (1000000::hugeint * c.f * c.f) // (x.f::hugeint * y.f)
      from f2 c join f1 x on x.lang = c.lang and x.w1 = c.w1 join f1 y on y.lang = c.lang and y.w1 = c.w2
      left join longer g on g.lang = c.lang and g.w1 = c.w1 and g.w2 = c.w2 where g.f is null or 100 * g.f < 50 * c.f),
k as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from c)
select k.lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from k join n using (lang) where rank <= 2000
"""

SQL_OP13 = r"""
with t as (select doc_id, row_number() over () row, regexp_extract_all(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
b as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) x from benchmark),
tot as (select count(*) n_docs, sum(len(w))::bigint n_terms from t where len(w) > 0),
o as (select doc_id, row, len(w) n, unnest(w) x from t),
tf as (select doc_id, row, n, x, count(*) tf from o group by all),
df as (select x, count(*) df from tf group by x),
g as (select doc_id, row, x, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint
             * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))) gain
      from tf join df using (x), tot),
s as (select item_id, doc_id, row, sum(gain)::bigint score from g join b using (x) group by all),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) rank from s where score > 0)
select item_id, rank::int rank, doc_id, score from k where rank <= 50
"""

ORACLE_SQL = {
    "op11_collocations": SQL_OP11,
    "op13_ranked": SQL_OP13,
    "op3_winnowing": SQL_OP3,
    "op7_line_dedup": SQL_OP7,
}
