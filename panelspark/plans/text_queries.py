"""Queries of text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import files
from ..sources.tables import events, table
from .catalog import ORACLES, query


def nested(x: str, steps: list[tuple[str, str]]) -> str:
    """SQL that replaces patterns in x one after another."""
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


def decoded(x: str) -> str:
    for name, char in text.HTML_ENTITIES.items():
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


BLOCKS_SQL = [("(?is)<script[^>]*>.*?</script>", ""), ("(?is)<style[^>]*>.*?</style>", ""), ("<[^>]+>", " ")]
STRIPPED = decoded(nested("html", BLOCKS_SQL))
LINKED = [(r"https?://\S+", " <URL> "), (r"www\.\S+", " <URL> "), (r"\S+@\S+\.\S+", " <EMAIL> ")]
NUMBERED = [(r"(?i)\$\s*(\d+(?:\.\d+)?)\s*(million|billion|trillion|mn|bn|tn|m|b|t)?", " <MONEY> "), (r"(\d+(?:\.\d+)?)\s*(%|percent|pct|basis\s*points|bps)", " <PERCENT> "), (r"\b\d{6,}\b", " <BIGNUM> ")]
NAMED = [(r"\$([A-Z]{1,5})\b", r"<TICKER_\1>"), *((rf"(?i)\b\Q{n}\E\b", f"<TICKER_{text.ENTITIES[n]}>") for n in sorted(text.ENTITIES, key=len, reverse=True))]
BLANK = r"[ \t\n\r\f\v]+"


# X1, X8, U3
@query("txt_strip_html", f"SELECT page_id, trim({nested(STRIPPED, [(BLANK, ' ')])}) AS body FROM pages")
def txt_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.collapse(text.strip_html(F.col("html"))).alias("body"))


# Rows from a scan
@query("txt_links", r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def txt_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


# X3, X5
@query("txt_mark", f"SELECT doc_id, {nested('text', [*LINKED, *NUMBERED])} AS marked FROM documents")
def txt_mark(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.mark_numbers(text.mark_links(F.col("text"))).alias("marked"))


#: Sentences that name companies, as the invented texts do not.
HEADLINES = ["$AAPL and Apple Inc. rise", "bank of america, JPMorgan Chase & Co", "Amazon.com or amazon?", "the S&P 500, nasdaq", "johnson & johnson beat Visa Inc", "pineapple is no Apple"]
IN_LISTS = "[" + ", ".join(f"'{h}'" for h in HEADLINES) + "]"


# All documents, each with a headline before it
@query("txt_entities", f"SELECT doc_id, {nested('t', NAMED)} AS marked FROM (SELECT doc_id, {IN_LISTS}[doc_id % {len(HEADLINES)} + 1] || ' ' || text AS t FROM documents)")
def txt_entities(spark: SparkSession, d: str) -> DataFrame:
    headline = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("doc_id") % len(HEADLINES) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.mark_entities(F.concat(headline, F.lit(" "), "text")).alias("marked"))


# The whole cleaning, of texts in ASCII, whose letters SQL need not decompose
@query("txt_clean_ascii", f"SELECT page_id, substr(trim({nested(STRIPPED, [*LINKED, *NAMED, *NUMBERED, (BLANK, ' ')])}), 1, 2560) AS cleaned FROM pages WHERE regexp_full_match(html, '[\\x00-\\x7F]*')")
def txt_clean_ascii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.length("html") == F.octet_length("html")).select("page_id", text.clean(F.col("html")).alias("cleaned"))


#: A letter with an accent is the letter and a space, any other sign that is not ASCII a space, but for a few.
FOLDED = "array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN ascii(c) < 128 OR contains('€£¥°±×÷', c) THEN c WHEN ascii(strip_accents(c)) < 128 THEN strip_accents(c) || ' ' ELSE ' ' END), '')"


# With the decomposition of letters
@query("txt_clean", f"SELECT doc_id, substr(trim({nested(decoded(nested(FOLDED, BLOCKS_SQL)), [*LINKED, *NAMED, *NUMBERED, (BLANK, ' ')])}), 1, 2560) AS cleaned FROM documents")
def txt_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


SENTENCES = f"list_filter(list_transform(string_split({nested('t', [('(' + '|'.join(text.ABBREVIATIONS) + r')\.', r'\1<DOT>'), (r'([.!?])' + BLANK, r'\1' + chr(2))])}, chr(2)), lambda s: trim(replace(s, '<DOT>', '.'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: length(s) > 10)"


# All documents, each with abbreviations before it
@query("txt_sentences", f"SELECT doc_id, len(s) AS n, s[1] AS first_one, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENTENCES} AS s FROM (SELECT doc_id, 'Mr. Fox vs. Dr. Owl Inc. met Prof. Hare etc. today. ' || text AS t FROM documents))")
def txt_sentences(spark: SparkSession, d: str) -> DataFrame:
    found = text.sentences(F.concat(F.lit("Mr. Fox vs. Dr. Owl Inc. met Prof. Hare etc. today. "), "text"))
    docs = table(spark, d, "documents").select("doc_id", found.alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n"), F.element_at("s", 1).alias("first_one"), F.md5(F.array_join("s", "|")).alias("digest"))


TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+', '', 'g'), '[^a-z0-9\s.,\-%$]', '', 'g'), '([0-9]+)', ' \1 ', 'g'), '\s+'), lambda t: t <> '')"


# X9
@query("txt_tokens", f"SELECT doc_id, len(t) AS n, t[1] AS first_token, t[-1] AS last_token FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE len(t) > 0")
def txt_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).where("size(t) > 0")
    return docs.select("doc_id", F.size("t").cast("long").alias("n"), F.element_at("t", 1).alias("first_token"), F.element_at("t", -1).alias("last_token"))


# A39
@query("txt_vocabulary", f"SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 496)")
def txt_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(text.tokens(F.col("text")).alias("t"))
    return text.vocabulary(docs, "t", 2, 500).select("token", "n", F.col("id").cast("long").alias("id"))


# Written as JSON and read back
@query("txt_vocabulary_file", ORACLES["txt_vocabulary"])
def txt_vocabulary_file(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "vocabulary")
    files.write_vocabulary(txt_vocabulary(spark, d), path)
    return files.read_vocabulary(spark, path)


# A fixed table of 16 tokens
SMALL = {t: i + 4 for i, t in enumerate(["the", "and", "of", "de", "la", "der", "die", "und", "que", "les", "in", "to", "a", "is", "el", "los"])}


@query(
    "txt_encode",
    f"SELECT item_id, array_to_string(list_concat(list_concat([2], list_transform(t[1:30], lambda x: coalesce(m[x], 1))), list_concat([3], list_transform(range(32), lambda i: 0)))[1:32], ' ') AS ids FROM (SELECT item_id, {TOKENS} AS t, MAP {{{', '.join(f"'{k}': {v}" for k, v in SMALL.items())}}} AS m FROM benchmark)",
)
def txt_encode(spark: SparkSession, d: str) -> DataFrame:
    ids = text.encode(text.tokens(F.col("text")), SMALL, 32)
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"))


# The texts of a group joined and encoded; padding alone where there are no words
@query(
    "txt_day_encode",
    f"SELECT conv_id, CASE WHEN len(t) = 0 THEN array_to_string(list_transform(range(32), lambda i: 0), ' ') ELSE array_to_string(list_concat(list_concat([2], list_transform(t[1:30], lambda x: coalesce(m[x], 1))), list_concat([3], list_transform(range(32), lambda i: 0)))[1:32], ' ') END AS ids FROM (SELECT conv_id, {TOKENS} AS t, MAP {{{', '.join(f"'{k}': {v}" for k, v in SMALL.items())}}} AS m FROM (SELECT conv_id, string_agg(text, ' . ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id))",
)
def txt_day_encode(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(text.day_text(F.col("text"), F.col("turn")).alias("text"))
    ids = text.encode(text.tokens(F.col("text")), SMALL, 32)
    return joined.select("conv_id", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"))


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def lexicon_sql(positive: list[str], negative: list[str], intense: list[str]) -> str:
    return f"""SELECT conv_id, turn, md5(text) AS row_key, round(s, 6) AS score, CASE WHEN s > 0.15 THEN 'positive' WHEN s < -0.15 THEN 'negative' ELSE 'neutral' END AS label, round(CASE WHEN p + n = 0 THEN 0.3 ELSE least(0.4 + 0.1 * (p + n), 0.85) END, 6) AS confidence
FROM (SELECT *, coalesce(greatest(least((p - n) / nullif(p + n, 0)::DOUBLE * (1 + 0.2 * least(i, 3)), 1), -1), 0) AS s FROM (
  SELECT *, len(list_filter(t, lambda x: x IN {in_list(positive)})) AS p, len(list_filter(t, lambda x: x IN {in_list(negative)})) AS n, len(list_filter(t, lambda x: x IN {in_list(intense)})) AS i FROM (SELECT *, regexp_split_to_array(lower(text), '\\s+') AS t FROM conversations)))"""


#: Words of the invented texts, so that a lexicon has something to find.
FOUND = (["the", "la", "der"], ["of", "de", "und"], ["and", "que"])


def scored(spark: SparkSession, d: str, *lists: list[str]) -> DataFrame:
    parts = text.lexicon(F.col("text"), *lists)
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("row_key"), F.round(parts["score"], 6).alias("score"), parts["label"].alias("label"), F.round(parts["confidence"], 6).alias("confidence"))


# X18
@query("txt_lexicon", lexicon_sql(text.POSITIVE, text.NEGATIVE, text.INTENSE))
def txt_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d)


# With a caller's own lists
@query("txt_lexicon_own", lexicon_sql(*FOUND))
def txt_lexicon_own(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, *FOUND)


# X19, A28, T22
@query(
    "txt_sentiment_by_role",
    f"""SELECT role, count(*) AS n, round(avg(coalesce((p - k) / nullif(len(t), 0)::DOUBLE, 0)), 6) AS mean_score FROM (SELECT role, t, len(list_filter(t, lambda x: x IN {in_list(FOUND[0])})) AS p, len(list_filter(t, lambda x: x IN {in_list(FOUND[1])})) AS k FROM (SELECT *, list_filter(regexp_split_to_array(lower(translate(text, ',.', '  ')), '\\s+'), lambda x: x <> '') AS t FROM conversations)) GROUP BY role""",
)
def txt_sentiment_by_role(spark: SparkSession, d: str) -> DataFrame:
    tone = text.net_tone(F.col("text"), FOUND[0], FOUND[1])
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(tone), 6).alias("mean_score"))


#: FNV-1a of each distinct word with 128-bit arithmetic, and the words' votes on each bit.
PRINTS = f"""w AS (SELECT doc_id, t, count(*) AS k FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\t\\n\\v\\f\\r\\x1C-\\x1F \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda t: t <> '')) AS t FROM documents) GROUP BY ALL),
h AS (SELECT t, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, octet_length(encode(t)) + 1), lambda i: ('0x' || substr(hex(encode(t)), 2 * i - 1, 2))::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM (SELECT DISTINCT t FROM w)),
v AS (SELECT doc_id, i, sum(CASE WHEN (h // (1::HUGEINT << i)) % 2 = 1 THEN k ELSE -k END) AS v FROM w JOIN h USING (t), (SELECT unnest(range(64))::INTEGER AS i) GROUP BY ALL),
p AS (SELECT doc_id, coalesce(f, 0) AS f FROM documents LEFT JOIN (SELECT doc_id, sum(CASE WHEN v > 0 THEN 1::HUGEINT << i ELSE 0 END)::HUGEINT AS f FROM v GROUP BY doc_id) USING (doc_id))"""


# X14, X15
@query("txt_simhash", f"WITH {PRINTS} SELECT doc_id, (CASE WHEN f >= 9223372036854775808::HUGEINT THEN f - 18446744073709551616::HUGEINT ELSE f END)::BIGINT AS print FROM p")
def txt_simhash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.simhash(text.print_words(F.coalesce("text", F.lit("")))).alias("print"))


# Pairs of distinct fingerprints, by their first documents
@query("txt_near_prints", f"WITH {PRINTS}, u AS (SELECT f, min(doc_id) AS n FROM p GROUP BY f) SELECT x.n AS a, y.n AS b FROM u x JOIN u y ON x.n < y.n AND bit_count(xor(x.f, y.f)) <= 3")
def txt_near_prints(spark: SparkSession, d: str) -> DataFrame:
    return text.near_fingerprints(txt_simhash(spark, d).groupBy("print").agg(F.min("doc_id").alias("n")), "print")


# Greedy, the first of near documents stays
@query(
    "txt_keep_first",
    f"""WITH RECURSIVE {PRINTS}, q AS MATERIALIZED (SELECT doc_id, f, row_number() OVER (ORDER BY doc_id) AS pos FROM p),
s AS (SELECT 0::BIGINT AS pos, NULL::BIGINT AS doc_id, []::HUGEINT[] AS held, false AS kept
UNION ALL SELECT pos, doc_id, CASE WHEN near THEN held ELSE held || [f] END, NOT near FROM (SELECT q.pos, q.doc_id, q.f, s.held, len(list_filter(s.held, lambda x: bit_count(xor(x, q.f)) <= 3)) > 0 AS near FROM s JOIN q ON q.pos = s.pos + 1))
SELECT doc_id, kept FROM s WHERE pos > 0""",
)
def txt_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return text.keep_first(files.stored(txt_simhash(spark, d)), "doc_id", "print", files.stored)


# Literals of SQL text
@query("txt_sql_literals", "SELECT c_custkey, 'INSERT INTO customer VALUES (' || c_custkey || ', ''' || replace(c_name, '''', '''''') || ''', ' || coalesce(c_nationkey::VARCHAR, 'NULL') || ');' AS stmt FROM customer")
def txt_sql_literals(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit("'"), F.replace("c_name", F.lit("'"), F.lit("''")), F.lit("'"))
    values = F.concat_ws(", ", F.col("c_custkey").cast("string"), quoted, F.coalesce(F.col("c_nationkey").cast("string"), F.lit("NULL")))
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("INSERT INTO customer VALUES ("), values, F.lit(");")).alias("stmt"))


# The same text parsed back
@query("scan_sql_dump", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey FROM customer")
def scan_sql_dump(spark: SparkSession, d: str) -> DataFrame:
    row = r"VALUES \((\d+), '((?:[^']|'')*)', (\w+)\)"
    part = lambda i: F.regexp_extract("stmt", row, i)
    return txt_sql_literals(spark, d).select(part(1).try_cast("long").alias("c_custkey"), F.replace(part(2), F.lit("''"), F.lit("'")).alias("c_name"), part(3).try_cast("long").alias("c_nationkey"))


# P11, P12
@query("txt_search", "SELECT s_suppkey, s_name FROM supplier WHERE contains(upper(s_name), '7') ORDER BY s_suppkey LIMIT 20")
def txt_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where(F.contains(F.upper("s_name"), F.lit("7"))).orderBy("s_suppkey").limit(20).select("s_suppkey", "s_name")


# Canonical signatures
@query("txt_signature", "SELECT user_id, sha256(array_to_string(list_sort(list_distinct(list(upper(trim(event_type))))), ',')) AS signature FROM events GROUP BY user_id")
def txt_signature(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.upper(F.trim("event_type")))), ","), 256).alias("signature"))


# An audit of a corpus
@query("scan_corpus_audit", "SELECT count(*) AS n, count(*) FILTER (WHERE length(trim(text)) > 0) AS filled, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents")
def scan_corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    # texts of any length count by a 128-bit digest, which shuffles 16 bytes for each
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.trim("text")) > 0).alias("filled"), F.countDistinct(F.unhex(F.md5("text"))).alias("texts"), F.countDistinct("source").alias("sources"))
