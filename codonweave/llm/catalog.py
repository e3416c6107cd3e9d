"""The registered corpus queries opN_<name> and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonweave.llm import balltree, bpe, containment, language, licenses, lm, near, packing, quality, secrets, spelling, tokens, toxicity
from codonweave.llm.classify import held_out
from codonweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its score; null and empty texts have no tokens, repeated rows score alike."""
    return lm.train_and_score(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every row of documents; null and empty texts are one piece of one id."""
    return packing.pieces(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of a document and a benchmark item that it holds; null and empty texts hold none, repeated rows repeat."""
    found = containment.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with counts and spans of its secrets; none for null and empty texts."""
    return secrets.digests(secrets.secrets(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its measures and verdict; zeros and a failure for null and empty texts."""
    return quality.quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its predicted language; 'und' for texts without a letter, repeated rows alike."""
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its counts; zeros for null and empty texts."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its score, null and empty texts too; repeated rows alike."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of a document and a license template that it holds; null and empty texts hold none, repeated rows repeat."""
    return licenses.licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", "n_item", "n_shared")


def op9_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op9_license_scan, which has taken over its templates."""
    return op9_license_scan(spark, sf_dir)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its set size and group; texts without words are groups of their own."""
    return near.near_groups(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least 7 characters and 2 occurrences in documents, with its form, root and number of near words."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the digests of its ids and of the text decoded from them; no ids for null and empty texts."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each row of benchmark; null and empty texts are never among them."""
    return balltree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    found = (
        op1_lm_scoring, op2_packing, op3_decontamination, op4_secret_scan, op5_quality_rules,
        op6_language_id, op7_token_counts, op8_toxicity, op9_license_scan, op9_license_texts, op10_jaccard_join,
        op11_spelling_variants, op12_bpe_round_trip, op13_lexical_search,
    )
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: A word is in a repeated window of k words if one of the k windows over it occurs twice; a repeat of k words covers the same words.
_REPEATS = """
    select r, i, {k} as k from (
        select r, unnest(range(b, b + {k})) as i from (
            select r, b, count(*) over (partition by r, win) as c from (
                select r, unnest(range(1, len(words) - {k} + 2)) as b, list_slice(words, b, b + {k} - 1) as win from w where len(words) >= {k})) where c > 1)
    group by r, i"""

_OP5 = f"""
with w as (select row_number() over () as r, doc_id, text, {_WORDS} as words from documents),
rep5 as ({_REPEATS.format(k=5)}), rep10 as ({_REPEATS.format(k=quality.MIN_REPEAT)}), rep51 as ({_REPEATS.format(k=quality.MAX_REPEAT + 1)}),
n5 as (select r, count(*) as c from rep5 group by r), n10 as (select r, count(*) as c from rep10 group by r), n51 as (select distinct r from rep51),
lines as (select r, line, count(*) as c from (select r, unnest(string_split(text, chr(10))) as line from w where text is not null) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r, line),
dup as (select r, sum(c - 1) as c from lines group by r)
select doc_id, len(words)::bigint as n_words, coalesce(length(array_to_string(words, chr(32))), 0)::bigint - greatest(len(words) - 1, 0) as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(dup.c, 0)::bigint as n_dup_lines, coalesce(n5.c, 0)::bigint as n_repeat_words, coalesce(n10.c, 0)::bigint as covered_words,
    (len(words) < 10 or 100 * coalesce(n5.c, 0) > 20 * len(words)) as base_failed,
    not (len(words) < 10 or 100 * coalesce(n5.c, 0) > 20 * len(words)) and 100 * coalesce(n10.c, 0) <= {quality.MAX_COVERED} * len(words) and n51.r is null as kept
from w left join dup using (r) left join n5 using (r) left join n10 using (r) left join n51 using (r)
"""
_OP10 = f"""
with recursive w as (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
s as (select distinct r, win from (
    select r, list_slice(words, b, b + 4) as win from (select r, words, unnest(range(1, greatest(len(words) - 3, 2))) as b from w where len(words) > 0))),
n as (select r, count(*) as n from s group by r),
pairs as (select a.r as x, b.r as y, count(*) as c from s a join s b on a.win = b.win and a.r < b.r group by a.r, b.r),
links as (select x, y from pairs join n p on p.r = x join n q on q.r = y where 100 * c >= 75 * (p.n + q.n - c)),
twoway as (select x, y from links union select y, x from links),
reach as (select r as x, r as y from w union select reach.x, twoway.y from reach join twoway on reach.y = twoway.x)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(v.doc_id) as component_id
from w left join n using (r) join reach on reach.x = w.r join w v on v.r = reach.y group by w.r, w.doc_id
"""


_CONTAINED = """
with d as (select row_number() over () as r, doc_id, regexp_extract_all({fold}, '[^\\x20\\x09-\\x0D]+') as words from documents),
i as (select row_number() over () as q, {key}, regexp_extract_all({fold}, '[^\\x20\\x09-\\x0D]+') as words from {items}),
ss as (select distinct q, {key}, list_slice(words, b, b + k - 1) as win from (select q, {key}, words, least(len(words), 5) as k, unnest(range(1, greatest(len(words) - 3, 2))) as b from i where len(words) > 0)),
ds as (select distinct r, doc_id, list_slice(words, b, b + k - 1) as win from (select r, doc_id, words, k, unnest(range(1, len(words) - k + 2)) as b from d, (select distinct len(win) as k from ss) where len(words) >= k) where words[b] in (select win[1] from ss)),
n as (select q, count(*) as n_item from ss group by q)
select doc_id, {key}, n_item, count(*)::bigint as n_shared from ss join n using (q) join ds using (win) group by r, doc_id, q, {key}, n_item having 100 * count(*) >= 75 * n_item
"""
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BARE = f"regexp_replace({_FOLD}, '[!-/:-@\\[-`{{-~]', '', 'g')"
_NOTICES = "(values " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items()) + ") t(license, text)"


#: CRC-32 of "<doc_id>:<run>" byte by byte, from a table of 256 numbers that eight halvings make; near words share what is left without one character.
_OP11 = """
with recursive halved as (select b, b::ubigint as c, 0 as k from range(256) t(b) union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from halved where k < 8),
crc as (select b, c from halved where k = 8),
runs as (select coalesce(doc_id::varchar, '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')) as run from documents) where length(run) >= 7 group by all),
hexed as (select row_number() over () as r, run, n, hex(encode(id || ':' || run)) as bytes from runs),
walk as (select r, 0 as k, bytes, 4294967295::ubigint as h from hexed
    union all select r, k + 1, bytes, xor(crc.c, h >> 8) from walk join crc on crc.b = xor(h & 255, ('0x' || substr(bytes, 2 * k + 1, 2))::ubigint) where 2 * k < length(bytes)),
hashed as (select hexed.run, n, xor(h, 4294967295::ubigint) as h from walk join hexed using (r) where 2 * walk.k = length(walk.bytes)),
words as (select word, sum(n)::bigint as n from (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed)
    where length(word) >= 7 group by word having sum(n) >= 2),
cuts as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from (select word, n, unnest(range(1, length(word) + 1))::int as i from words)),
shorter as (select distinct word, n, cut from cuts),
near as (select a.word, a.n, b.word as other, b.n as other_n from cuts a join cuts b on a.cut = b.cut and a.i = b.i and a.word <> b.word
    union all select s.word, s.n, w.word, w.n from shorter s join words w on w.word = s.cut
    union all select w.word, w.n, s.word, s.n from shorter s join words w on w.word = s.cut),
best as (select word, other, other_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, other) as place from near),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * n then other end as form, case when other_n >= 10 * n then other_n end as form_n from words w left join best b on b.word = w.word and place = 1),
ways as (select word, form as goal from forms where form is not null union all select ways.word, f.form from ways join forms f on f.word = ways.goal where f.form is not null),
ends as (select ways.word, goal as root from ways join forms f on f.word = ways.goal where f.form is null)
select word, form, coalesce(root, word) as root, n, n_near, form_n from forms left join ends using (word)
"""
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')"
_OP13 = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as terms from documents),
sizes as (select count(*) as many, sum(len(terms))::bigint as total from d where len(terms) > 0),
q as (select row_number() over () as q, item_id, list_distinct({_TERMS}) as terms from benchmark),
qt as (select q, item_id, unnest(terms) as term from q),
dt as (select r, term, count(*) as tf from (select r, unnest(terms) as term from d) where term in (select term from qt) group by r, term),
w as (select term, floor(1000 * ln((2 * many + 2) / (2 * count(*) + 1)::double))::bigint as w from dt, sizes group by term, many),
impact as (select dt.r, d.doc_id, dt.term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * many) // total)) as x from dt join d using (r), sizes),
scores as (select q, item_id, r, doc_id, sum(w * x)::bigint as score from qt join w using (term) join impact using (term) group by q, item_id, r, doc_id having sum(w * x) > 0),
ranks as (select item_id, row_number() over (partition by q order by score desc, doc_id)::int as rank, doc_id, score from scores)
select * from ranks where rank <= {balltree.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": _CONTAINED.format(fold=_FOLD, key="item_id", items="benchmark"),
        "op5_quality_rules": _OP5,
        "op9_license_scan": _CONTAINED.format(fold=_BARE, key="license", items=_NOTICES),
        "op9_license_texts": _CONTAINED.format(fold=_BARE, key="license", items=_NOTICES),
        "op10_jaccard_join": _OP10,
        "op11_spelling_variants": _OP11,
        "op13_lexical_search": _OP13,
    }
