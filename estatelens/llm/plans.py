"""The queries of this subpackage, bound to the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm import bpe, decontaminate, langid, licenses, prefixtrie, repeats, simhash, spelling, tokenfile, toxicity, urlfilter, vectors, warc
from estatelens.llm.common import id_remainder, read


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(read(spark, sf_dir, "embeddings"), k=20, query=lambda vec_id: vec_id % 20 == 0)


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, which is never part of the repository."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(id_remainder(F.col("doc_id"), 5) != 0))
    held = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(id_remainder(F.col("doc_id"), 4) != 2))
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return toxicity.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(read(spark, sf_dir, "documents")).drop("spans")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.new_folder(spark)
    tokenfile.write_tokens(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), folder, end_id=1)
    return tokenfile.token_digests(spark, folder)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    archives = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_records(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_nodes(read(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read(spark, sf_dir, "documents"))


def _strength(level: str, least: float = 1.0, most: float = 100.0) -> str:
    return f"""(SELECT coalesce(CASE WHEN ss > v1 THEN least(greatest((vn - ss) / (ss - v1), {least}), {most}) END, {most}) FROM (
        SELECT sum(n * (bad / n - mean) * (bad / n - mean)) AS ss, sum(n * mean * (1 - mean)) AS vn, sum(mean * (1 - mean)) AS v1 FROM {level} WHERE n > 0))"""


def op10_sql() -> str:
    fits = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(urlfilter.RULES, key=lambda r: -len(r[0]) - len(r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{value(h, p, act)}'" for h, p, act in ordered) + " END"
    two = ", ".join(f"'{x}'" for x in urlfilter.TWO_LABEL_SUFFIXES)
    last = lambda n: f"array_to_string(string_split(name, '.')[-{n}:], '.')"
    return f"""
    WITH rest AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    named AS (SELECT *, {case(lambda h, p, a: h + p)} AS rule, {case(lambda h, p, a: a)} AS action, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM parts),
    judged AS (SELECT *, CASE WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM named),
    hosts AS (SELECT host, domain, suffix, count(action)::DOUBLE AS n, count(*) FILTER (WHERE action = 'block')::DOUBLE AS bad FROM judged GROUP BY ALL),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM hosts) AS mean FROM domains GROUP BY suffix),
    s AS (SELECT suffix, (bad + m * mean) / (n + m) AS mean FROM (SELECT *, {_strength('suffixes')} AS m FROM suffixes)),
    d0 AS (SELECT domains.*, mean FROM domains JOIN s USING (suffix)),
    d AS (SELECT domain, (bad + m * mean) / (n + m) AS mean FROM (SELECT *, {_strength('d0')} AS m FROM d0)),
    h0 AS (SELECT hosts.*, mean FROM hosts JOIN d USING (domain)),
    h AS (SELECT host, (bad + m * mean) / (n + m) AS mean, n + m AS total FROM (SELECT *, {_strength('h0')} AS m FROM h0))
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN mean - sqrt(mean * (1 - mean) / (total + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged JOIN h USING (host)"""


# crc32 of UTF-8 bytes, bytewise: the table comes from its polynomial by rule
_CRC = """list_transform(range(0, 256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"""


def _crc32(text: str, table: str) -> str:
    digits = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(0, length({digits}) // 2), lambda i: CAST('0x' || substr({digits}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


OP6_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM d"""


def op11_sql() -> str:
    return f"""
    WITH k AS (SELECT {_CRC} AS crc), t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS r, coalesce(text, '') AS x
      FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY pos) AS s FROM t GROUP BY c),
    h AS (SELECT c, s, {_crc32('CAST(c AS VARCHAR)', 'k.crc')} % 9 AS h FROM own, k),
    built AS (SELECT h.c, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN own b ON b.c = h.c - h.c % 5),
    p AS (SELECT c, len(s) AS n, d, s[1:d] AS p, CASE WHEN d > 0 THEN strlen(s[d].x) ELSE 0 END AS size FROM built, unnest(range(0, len(s) + 1)) u(d)),
    nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY p, d),
    kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
    tree AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (p, d)),
    sub AS (SELECT p[1:a] AS p, a AS d, count(*) FILTER (WHERE kids = 0) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens FROM tree, unnest(range(0, d + 1)) u(a) GROUP BY ALL)
    SELECT t.conv_id, t.d AS depth, u.conv_id AS parent_conv_id, t.n_convs, t.kids AS n_children, n_leaves, saved_tokens, t.ends_sha256
    FROM tree t JOIN sub USING (p, d) LEFT JOIN nodes u ON u.d = t.d - 1 AND u.p = t.p[1:t.d - 1]"""


def op12_sql() -> str:
    return f"""
    WITH RECURSIVE k AS MATERIALIZED (SELECT {_CRC} AS crc),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
    c AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
    h AS (SELECT w, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w", 'k.crc')} AS h FROM c, k),
    v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h)
      GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
    cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, unnest(range(0, length(word))) u(i)),
    near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = cut.rest UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = cut.rest),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
    f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
    up(word, last) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.last WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, up.last AS root, f.n, f.n_near, f.form_n FROM f JOIN up USING (word) JOIN f g ON g.word = up.last WHERE g.form IS NULL"""


def op13_sql(slack: int = 3, least: float = 0.75) -> str:
    rows = [(i, exact, label, text) for i, (exact, (label, text)) in enumerate([(True, p) for p in licenses.PHRASES] + [(False, n) for n in licenses.NOTICES])]
    values = ", ".join(f"({i}, {str(exact).lower()}, '{label}', string_split('{text}', ' '))" for i, exact, label, text in rows)
    return f"""
    WITH t(template, exact, label, words) AS (VALUES {values}), tk AS (SELECT *, len(words) AS length, least(len(words), {licenses.GRAM}) AS k FROM t),
    tg AS (SELECT template, exact, label, length, k, t, array_to_string(words[t + 1:t + k], ' ') AS gram FROM tk, unnest(range(0, length - k + 1)) u(t)),
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    w AS (SELECT r, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM d),
    g AS (SELECT r, pos, word || ' ' || lead(word) OVER o AS two, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS three FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)),
    hits AS (SELECT r, pos, tg.* FROM g JOIN tg ON tg.k = 2 AND tg.gram = g.two UNION ALL SELECT r, pos, tg.* FROM g JOIN tg ON tg.k = 3 AND tg.gram = g.three),
    lines AS (SELECT r, template, exact, label, length, k, pos - t AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi, list(t) AS ts FROM hits GROUP BY ALL),
    places AS (SELECT r, label, diagonal AS first FROM lines WHERE exact AND votes = length - k + 1),
    cut AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) > {slack} OR lo > lag(hi) OVER o + k + {slack} OR lag(lo) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM lines WHERE NOT exact WINDOW o AS (PARTITION BY r, template ORDER BY lo, diagonal)),
    isl AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY lo, diagonal ROWS UNBOUNDED PRECEDING) AS island FROM cut),
    m AS (SELECT r, label, length, k, max(hi) + k - min(lo) AS span, list_distinct(flatten(list(ts))) AS ts FROM isl GROUP BY r, template, label, length, k, island),
    n AS (SELECT r, label, len(list_distinct(flatten(list_transform(ts, lambda t: range(t, t + k))))) / length AS covered, span <= length * 1.25 + {slack} AS dense FROM m),
    found AS (SELECT r, label, first, 1.0::DOUBLE AS covered, true AS base, true AS named FROM places UNION ALL SELECT r, label, NULL, covered, false, covered >= {least} AND dense FROM n)
    SELECT doc_id, len(any_value(words)) AS n_words, count(*) FILTER (WHERE base) AS n_base, min(first) AS first_word, max(first) AS last_word,
      coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE named))), ','), '') AS labels,
      coalesce(max(covered), 0)::DOUBLE AS score FROM d LEFT JOIN found USING (r) GROUP BY r, doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and not name.endswith("_sql")}


def oracles() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op10_url_reputation": op10_sql(), "op11_prefix_trie": op11_sql(), "op12_spelling": op12_sql(), "op13_licenses": op13_sql()}
