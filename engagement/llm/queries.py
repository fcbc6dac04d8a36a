"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .collocations import mine_collocations
from .prefix_tree import REST, Vocabulary, pack_conversations, read_back
from .quality_rules import judge_quality
from .rule_classifier import score_quality
from .sentence_pieces import encode_pieces
from .shingle_join import similar_documents
from .source_mix import mix_sources, mix_sql
from .span_dedup import dedup_spans
from .surrogates import replace_personal_data
from .token_counts import count_tokens
from .url_digests import UNWANTED, judge_urls, unwanted_hosts
from .vector_codes import compress_vectors
from .vector_forest import near_vectors

#: Whoever runs this on real data keeps a key of their own, in a secret place.
SURROGATE_KEY = "example-key"
#: Host and path rules that decide before the block list.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(_table(spark, folder, "documents"))


def op3_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), sharpness=1.0, seed=0, keep=("doc_id",))


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_table(spark, folder, "documents"), exponent=0.7, epochs=1.0, seed=0)


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return replace_personal_data(_table(spark, folder, "documents"), key=SURROGATE_KEY)


def op6_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(_table(spark, folder, "documents"), k=3, percent=90)


def op7_vector_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"), least=0.95)


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return judge_urls(pages, URL_RULES, unwanted_hosts(pages))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return dedup_spans(docs, window=20, k=6, keep_text=False).drop("kept_text")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"), threshold=0.7)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    found = compress_vectors(_table(spark, folder, "embeddings"), parts=16, entries=64, rounds=2)
    digest = hashlib.sha256(found.flat().encode()).hexdigest()
    # A sum of a label is one row, however many vectors have it; beyond 64 bits it is null.
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    labels = found.codes.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    coded = found.codes.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return mine_collocations(_table(spark, folder, "documents"), least=30, share=80, top=2000)


def op13_prefix_tree(spark: SparkSession, folder: str) -> DataFrame:
    chats = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    chats = chats.unionByName(spark.createDataFrame(added, "conv_id long, turn long, role string, text string"))
    vocabulary = Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return read_back(pack_conversations(chats, vocabulary), vocabulary)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_source_mix": op4_source_mix,
    "op5_personal_data": op5_personal_data,
    "op6_shingle_join": op6_shingle_join,
    "op7_vector_forest": op7_vector_forest,
    "op8_url_filters": op8_url_filters,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_prefix_tree": op13_prefix_tree,
}


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Rounds of assignment and integer means, every distance computed."""
    steps = [f"""
        rows as (select row_number() over () as r, vec_id, label,
            list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
            from embeddings
            where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        cut as (select r, j, v[j * (len(v) // {parts}) + 1:(j + 1) * (len(v) // {parts})] as x
            from rows, range({parts}) as t(j)),
        firsts as (select r, row_number() over (order by vec_id) - 1 as e from rows),
        book0 as (select j, e, x from cut join firsts using (r) where e < {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""
        near{n} as (select r, j, any_value(c.x) as x, min(struct_pack(d := list_sum(list_transform(
            list_zip(c.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, e := e)) as best
            from cut c join book{n} b using (j) group by r, j)""")
        if n < rounds:
            steps.append(f"""
        sums{n} as (select j, best.e as e, i, sum(x[i]) as s, count(*)::hugeint as c
            from near{n}, range(1, len(x) + 1) as t(i) group by all),
        means{n} as (select j, e, list(((s - ((s % c) + c) % c) // c)::bigint order by i) as x from sums{n} group by j, e),
        book{n + 1} as (select j, e, coalesce(m.x, b.x) as x from book{n} b left join means{n} m using (j, e))""")
    return f"""
        with {",".join(steps)},
        digest as (select sha256(string_agg(array_to_string(x, ','), ',' order by j, e)) as codebooks_sha256 from book{rounds}),
        coded as (select r, string_agg(printf('%02x', best.e::int), '' order by j) as code, sum(best.d)::bigint as error
            from near{rounds} group by r)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
        from rows join coded using (r) cross join digest
    """


ORACLE: dict[str, str] = {
    "op11_vector_codes": _codes_sql(16, 64, 2),
    "op13_prefix_tree": rf"""
        with chats as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ),
        turns as (
            select *, 32 + length(regexp_replace(role, '([<\[])(\\*)({REST})', '\1\\\2\3', 'g'))
                + length(regexp_replace(text, '([<\[])(\\*)({REST})', '\1\\\2\3', 'g')) as chars
            from chats
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            sum(chars)::bigint as formatted_chars
        from turns group by conv_id
    """,
    "op12_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
            from documents
        ),
        words as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
        totals as (select lang, sum(len(w))::bigint as n from words group by lang),
        grams as (
            select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
            from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 5) as t(k))
        ),
        counts as (select lang, k, phrase, count(*) as a from grams group by all having count(*) >= 30),
        cuts as (
            select lang, k as words, phrase, a, cut, string_split(phrase, ' ') as w
            from counts, range(1, 4) as t(cut) where k > 1 and cut < k
        ),
        scored as (
            select c.lang, c.phrase, c.words, c.a, min(struct_pack(score := (2000000::hugeint * c.a // (l.a + r.a))::bigint, cut := cut, l := l.a, r := r.a)) as low
            from cuts c join counts l on l.lang = c.lang and l.phrase = array_to_string(w[:cut], ' ')
            join counts r on r.lang = c.lang and r.phrase = array_to_string(w[cut + 1:], ' ')
            group by all
        ),
        kept as (
            select * from scored s where not exists (
                select 1 from counts x where x.lang = s.lang and x.k > s.words
                and contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' ') and 100::hugeint * x.a >= 80::hugeint * s.a)
        ),
        ranked as (
            select lang, row_number() over (partition by lang order by low.score desc, a desc, phrase) as rank,
                phrase, a, low.l as l, low.r as r, low.score as score
            from kept
        )
        select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
    """,
    "op4_source_mix": mix_sql(0.7, 0),
    "op6_shingle_join": r"""
        with recursive words as (
            select doc_id, list_filter(
                string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[ 	-
]+'), lambda w: w <> '') as w
            from documents
        ),
        shingles as (
            select distinct doc_id, unnest(case when len(w) >= 3
                then list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])
                when len(w) > 0 then [w] else [] end) as s
            from words
        ),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        common as (
            select a.doc_id as a, b.doc_id as b, count(*) as n
            from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
            group by all
        ),
        links as (
            select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b
            where 100 * c.n >= 90 * (x.n + y.n - c.n)
        ),
        reach(doc_id, other) as (
            select doc_id, doc_id from documents
            union
            select r.doc_id, l.b from reach r join links l on l.a = r.other
        ),
        component as (select doc_id, min(other) as component_id from reach group by doc_id)
        select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id
        from documents d left join sizes s using (doc_id) join component c using (doc_id)
    """,
    "op7_vector_forest": """
        with recursive vectors as (
            select vec_id, embedding::double[] as v, coalesce(len(embedding) > 0 and len(list_filter(embedding,
                lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as ok
            from embeddings
        ),
        links as (
            select a.vec_id as a, b.vec_id as b from vectors a join vectors b
            on a.ok and b.ok and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95
        ),
        reach(vec_id, other) as (
            select vec_id, vec_id from vectors
            union
            select r.vec_id, l.b from reach r join links l on l.a = r.other
        ),
        component as (select vec_id, min(other) as component_id from reach group by vec_id)
        select vec_id, (select count(*) from links where a = c.vec_id) as n_links, component_id, vec_id = component_id as kept
        from component c
    """,
    "op8_url_filters": f"""
        with parts as (
            select page_id,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from pages
        ),
        ruled as (
            select *, case
                when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
                when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
                when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
                when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/'
                when (host = 'org' or host like '%.org') and path like '/%' then 'org/'
            end as rule
            from parts
        ),
        list as (
            select distinct regexp_extract(host, '(?:^|\\.)((?:[^.]*-)?(?:{"|".join(UNWANTED)})(?:-[^.]*)?\\..+)$', 1) as h
            from parts
        ),
        listed as (
            select *, (select arg_max(h, length(h)) from list
                where h <> '' and (host = h or ends_with(host, '.' || h))) as entry
            from ruled
        )
        select page_id, host, path, rule, case
            when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block'
            when rule in ('com/fr/', 'org/') then 'allow'
            when entry is not null then 'block' else 'allow' end as verdict, entry
        from listed
    """,
    "op9_substring_dedup": r"""
        with words as (
            select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') as w
            from documents
        ),
        windows as (
            select doc_id, i, w[i:i + 19] as x
            from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from words)
        ),
        later as (
            select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) as r from windows)
            where r > 1
        ),
        removed as (
            select doc_id, list(distinct j) as gone from (select doc_id, unnest(range(i, i + 20)) as j from later) group by doc_id
        ),
        kept as (
            select doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed, w, coalesce(gone, []) as gone
            from words left join removed using (doc_id)
        )
        select doc_id, n_words, n_removed, sha256(array_to_string(list_transform(list_filter(
            list_zip(w, range(1, len(w) + 1)), lambda p: not list_contains(gone, p[2])), lambda p: p[1]), ' ')) as kept_sha256
        from kept
    """,
}
