"""One query per operator over its whole table, with SQL where SQL can say it."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_exact_dedup", r"""
    with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
    select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
           doc_id = min(doc_id) over w as kept, text_sha256
    from d window w as (partition by text_sha256)""")
def op2_exact_dedup(spark, sf_dir):
    from lendgrain.llm.exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark, sf_dir):
    from lendgrain.llm.simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path(name):
    """Where the public vocabulary files are installed; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op7_sentencepiece")
def op7_sentencepiece(spark, sf_dir):
    from lendgrain.llm.sentencepiece_bpe import digests
    return digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op6_decontaminate", rf"""
    with d as (select row_number() over () as rid, doc_id,
                      regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    b as (select cast(item_id as varchar) as item,
                 regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    grams as (select distinct item, least(len(w), 13) as n,
                     array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') as gram
              from b, unnest(range(1, len(w) - least(len(w), 13) + 2)) as u(i) where len(w) > 0),
    sizes as (select distinct n from grams),
    runs as (select rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram
             from d, sizes, unnest(range(1, len(w) - n + 2)) as u(i) where len(w) >= n),
    hits as (select rid, i, runs.n, item from runs join grams on runs.n = grams.n and runs.gram = grams.gram),
    words as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + n)) as k from hits) group by rid),
    items as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from hits group by rid)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(names, '')) as items_sha256,
           coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join words using (rid) left join items using (rid)""")
def op6_decontaminate(spark, sf_dir):
    from lendgrain.llm.decontaminate import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


@query("op5_substring_dedup", r"""
    with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    runs as (select rid, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as h
             from d, unnest(range(1, len(w) - 48)) as u(i) where len(w) >= 50),
    firsts as (select h, min(doc_id) as first from runs group by h),
    gone as (select rid, list(distinct k) as ks from (select rid, unnest(range(i, i + 50)) as k from runs join firsts using (h) where doc_id > first) group by rid),
    k as (select d.*, coalesce(ks, []) as ks from d left join gone using (rid))
    select doc_id, len(w) as n_words, len(ks) as n_removed,
           sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(ks, i)), ' ')) as kept_sha256
    from k""")
def op5_substring_dedup(spark, sf_dir):
    from lendgrain.llm.substring_dedup import without_copies
    return without_copies(table(spark, sf_dir, "documents")).drop("kept", "spans")


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    from lendgrain.llm.language_id import language_id
    return language_id(table(spark, sf_dir, "documents"))


@query("op4_warc", """
    with p as (select page_id, coalesce(html, '') as html from pages),
    d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
    f as (select *, min(page_id) over (partition by payload_digest) as first from d)
    select page_id, payload_bytes, payload_digest,
           case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= 100 and first <> page_id then first end as refers_to
    from f""")
def op4_warc(spark, sf_dir):
    from lendgrain.llm.shared import cut, drop_folder, new_folder
    from lendgrain.llm.warc import round_trip
    folder = new_folder(spark, "warc")
    found = cut(round_trip(table(spark, sf_dir, "pages"), folder=folder).drop("url", "payload"))
    drop_folder(spark, folder)  # the query's rows are read by now
    return found


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    from lendgrain.llm.shared import cut, drop_folder, new_folder
    from lendgrain.llm.token_files import round_trip
    folder = new_folder(spark, "tokens")
    found = cut(round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder=folder, with_ids=False))
    drop_folder(spark, folder)  # the query's rows are read by now
    return found


@query("op8_hilbert_shards")
def op8_hilbert_shards(spark, sf_dir):
    from lendgrain.llm.hilbert import shards
    return shards(table(spark, sf_dir, "documents"))


@query("op9_chat_format", r"""
    with t as (select conv_id, row_number() over (partition by conv_id order by turn) as k, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
    p as (select conv_id, k, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by k) as said,
                 k = count(*) over (partition by conv_id) as whole from t),
    kept as (select min(conv_id) as conv_id from p where whole and said not in (select said from p where not whole) group by said)
    select conv_id, (k - 1) // 256 as part, count(*) as n_turns,
           string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' order by k) as text
    from t join kept using (conv_id) group by 1, 2""")
def op9_chat_format(spark, sf_dir):
    from lendgrain.llm.chat import chats
    return chats(table(spark, sf_dir, "conversations"))


@query("op11_collocations", rf"""
    with d as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
    p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from d),
    g as (select lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))))) as phrase
          from p where len(w) > 0),
    f as materialized (select lang, phrase, count(*) as f from g group by all),
    n as (select lang, sum(f)::bigint as n from f where not contains(phrase, ' ') group by 1),
    c as materialized (select lang, phrase, f as a, string_split(phrase, ' ') as w from f where contains(phrase, ' ') and f >= 100),
    heads as (select lang, phrase, a, w, unnest(range(1, len(w))) as k from c),
    cuts as (select lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') as head, array_to_string(list_slice(w, k + 1, len(w)), ' ') as rest from heads),
    marks as (select cuts.lang, cuts.phrase, a, k, x.f as l, y.f as r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score
              from cuts join n using (lang) join f as x on x.lang = cuts.lang and x.phrase = head join f as y on y.lang = cuts.lang and y.phrase = rest),
    worst as (select *, row_number() over (partition by lang, phrase order by score, k) as place from marks),
    inner_parts as (select lang, a, unnest(flatten(list_transform(range(2, len(w)), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))))) as phrase
                    from c where len(w) > 2),
    longer as (select lang, phrase, max(a) as longer from inner_parts group by all),
    kept as (select worst.* from worst left join longer using (lang, phrase) where place = 1 and not coalesce(100 * longer >= 100 * a, false)),
    ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept)
    select * from ranked where rank <= 2000""")
def op11_collocations(spark, sf_dir):
    from lendgrain.llm.collocations import collocations
    from lendgrain.llm.shared import cut, drop_folder, new_folder
    folder = new_folder(spark, "phrases")
    found = cut(collocations(table(spark, sf_dir, "documents"), folder))
    drop_folder(spark, folder)  # the query's rows are read by now
    return found


TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op13_ranked_search", rf"""
    with d as (select row_number() over () as rid, doc_id, {TERMS.format(LOWER.format("coalesce(text, '')"))} as w from documents),
    s as (select count(*) filter (len(w) > 0) as total, sum(len(w))::bigint as length from d),
    i as (select row_number() over () as item, item_id, {TERMS.format(LOWER.format("coalesce(text, '')"))} as w from benchmark),
    q as materialized (select item, term, count(*) as many from (select item, unnest(w) as term from i) group by all),
    v as (select distinct term from q),
    tf as materialized (select rid, term, count(*) as tf from (select rid, unnest(w) as term from d) semi join v using (term) group by all),
    weights as materialized (select term, floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))::bigint as w from tf, s group by term),
    m as (select rid, doc_id, 100 - 25 + ((25 * len(w) * total) // nullif(length, 0)) as m from d, s),
    scores as (select item, rid, sum(many * weights.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
               from q join tf using (term) join weights using (term) join m using (rid) group by all),
    best as (select item, doc_id, score, row_number() over (partition by item order by score desc, doc_id) as place from scores join m using (rid) where score > 0)
    select item_id, place::int as rank, doc_id, score from best join i using (item) where place <= 20""")
def op13_ranked_search(spark, sf_dir):
    from lendgrain.llm.ranked_search import ranked
    from lendgrain.llm.shared import cut, drop_folder, new_folder
    folder = new_folder(spark, "search")
    found = cut(ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), folder))
    drop_folder(spark, folder)  # the query's rows are read by now
    return found


@query("op12_quality_score")
def op12_quality_score(spark, sf_dir):
    from lendgrain.llm.quality import quality
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
