"""Queries of the numbered operators over their whole tables, and the SQL that some of them must agree with."""

import public_tokenizers

from . import alignment, byte_bpe, decontamination, jaccard_join, line_dedup, packing, phrases, pitman_yor, sharding, toxicity, url_filter, vector_search, warc

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark, sf_dir):
    return url_filter.report(_table(spark, sf_dir, "pages"))


def op2_vector_search(spark, sf_dir):
    return vector_search.report(_table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.report(_table(spark, sf_dir, "pages"))


def op5_decontamination(spark, sf_dir):
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark, sf_dir):
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.report(_table(spark, sf_dir, "documents"))


def op10_pitman_yor(spark, sf_dir):
    return pitman_yor.report(_table(spark, sf_dir, "documents"))


def op11_phrases(spark, sf_dir):
    return phrases.mine(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark, sf_dir):
    return byte_bpe.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_alignment(spark, sf_dir):
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.report(_table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN)


QUERIES = {"op4_warc": op4_warc, "op2_vector_search": op2_vector_search, "op6_toxicity": op6_toxicity, "op10_pitman_yor": op10_pitman_yor, "op9_jaccard_join": op9_jaccard_join, "op7_sharding": op7_sharding, "op8_packing": op8_packing, "op1_url_filter": op1_url_filter, "op3_line_dedup": op3_line_dedup, "op5_decontamination": op5_decontamination, "op11_phrases": op11_phrases, "op12_byte_bpe": op12_byte_bpe, "op13_alignment": op13_alignment}

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _link_sql(kind, tag, mark, attribute):
    return rf"""
        SELECT url AS source, '{kind}' AS kind, replace(regexp_extract(list_filter(
            regexp_extract_all(coalesce(html, ''), '(?is)<{tag}\b[^>]*>'),
            lambda t: regexp_matches(t, '(?is){mark}') AND regexp_matches(t, '(?is)\b{attribute}')
        )[1], '(?is)\b{attribute}', 1), '&amp;', '&') AS t
        FROM pages WHERE contains(url, '://')"""


_QUOTE = "[\"'']?"
_HREF = rf"""\s*=\s*{_QUOTE}([^"''\s>]+)"""
_RULE_SQL = " ".join(
    f"""WHEN (host = '{text.split("/")[0]}' OR ends_with(host, '.{text.split("/")[0]}'))
        AND starts_with(path, '/{text.partition("/")[2]}') THEN '{action} {text}'"""
    for action, text in sorted(url_filter.RULES, key=lambda r: -len(r[1]))
)


def _parts_sql(url):
    return rf"""translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path"""


ORACLES = {
    "op1_url_filter": rf"""
        WITH RECURSIVE found AS (
            {_link_sql("canonical", "link", rf"\brel\s*=\s*{_QUOTE}canonical\b", "href" + _HREF)}
            UNION ALL {_link_sql("redirect", "meta", rf"\bhttp-equiv\s*=\s*{_QUOTE}refresh\b", "url" + _HREF)}),
        links AS (
            SELECT source, CASE WHEN contains(t, '://') THEN t
                WHEN starts_with(t, '//') THEN regexp_extract(source, '(?s)^([^:]*:)//', 1) || t
                WHEN starts_with(t, '/') THEN regexp_extract(source, '(?s)^([^:]*://[^/?#]*)', 1) || t END AS target
            FROM found),
        known AS (
            SELECT url FROM pages UNION SELECT source FROM links UNION SELECT target FROM links),
        bare AS (
            SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                url, '(?s)#.*$', ''), '([?&]){url_filter.TRACKING}=[^&]*', '\1', 'g'), '&{{2,}}', '&', 'g'), '\?&', '?', 'g'),
                '[?&]+$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:www\.|m\.)?', '') AS bare
            FROM known WHERE contains(url, '://')),
        edges AS (
            SELECT source AS a, target AS b FROM links WHERE target IS NOT NULL
            UNION SELECT url, 'alias://' || translate(regexp_extract(bare, '(?s)^([^/?]*)', 1), '{UPPER}', '{LOWER}')
                || regexp_replace(regexp_replace(bare, '(?s)^[^/?]*', ''), '/$', '') FROM bare),
        near AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        reach AS (SELECT a, a AS b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
        node AS (SELECT DISTINCT b AS url, {_parts_sql("b")} FROM near WHERE NOT starts_with(b, 'alias://')),
        acted AS (SELECT url, split_part(CASE {_RULE_SQL} END, ' ', 1) AS action FROM node),
        class AS (
            SELECT r.a AS url, bool_or(action = 'block') AND NOT coalesce(bool_or(action = 'allow'), false) AS blocked
            FROM reach r JOIN acted ON r.b = acted.url GROUP BY r.a),
        judged AS (SELECT page_id, url, {_parts_sql("url")} FROM pages),
        ruled AS (SELECT *, CASE {_RULE_SQL} END AS hit FROM judged)
        SELECT page_id, host, path, CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 2) END AS rule,
            CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 1) WHEN class.blocked THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled LEFT JOIN class ON ruled.url = class.url""",
    "op3_line_dedup": rf"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (
            SELECT r, doc_id, i, lines[i] AS line,
                trim(translate(lines[i], '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
            FROM doc, unnest(range(1, len(lines) + 1)) AS u(i)),
        frequent AS (
            SELECT key, max(doc_id) AS largest FROM line WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        lost AS (SELECT r, i FROM line JOIN frequent USING (key) WHERE doc_id <> largest),
        kept AS (
            SELECT line.r, string_agg(line, chr(10) ORDER BY line.i) AS text, count(*) AS n
            FROM line LEFT JOIN lost USING (r, i) WHERE lost.r IS NULL GROUP BY line.r)
        SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (r)""",
    "op11_phrases": rf"""
        WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
                translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
        piece AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM doc),
        worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
        gram AS (
            SELECT lang, m, list_slice(w, i, i + m - 1) AS g
            FROM worded, (SELECT unnest(range(1, 6)) AS m), unnest(range(1, len(w) - m + 2)) AS u(i)),
        total AS (SELECT lang, count(*) AS n FROM gram WHERE m = 1 GROUP BY lang),
        freq AS (SELECT lang, m, g, count(*) AS f FROM gram GROUP BY lang, m, g HAVING count(*) >= {phrases.MIN_COUNT}),
        cut AS (
            SELECT c.lang, c.m, c.g, c.f AS a, k, x.f AS l, y.f AS r, n, 1000::HUGEINT * c.f * n // (x.f::HUGEINT * y.f) AS score
            FROM freq c, unnest(range(1, c.m)) AS u(k)
            JOIN freq x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k)
            JOIN freq y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, c.m)
            JOIN total ON total.lang = c.lang),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM cut),
        inside AS (
            SELECT DISTINCT lang, list_slice(g, i, i + s - 1) AS g, f
            FROM freq, (SELECT unnest(range(2, 5)) AS s), unnest(range(1, m - s + 2)) AS u(i) WHERE s < m),
        kept AS (
            SELECT * FROM best WHERE place = 1 AND NOT EXISTS (
                SELECT 1 FROM inside i WHERE i.lang = best.lang AND i.g = best.g AND 100 * i.f >= {phrases.COVERED} * best.a)),
        ranked AS (
            SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score,
                row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
            FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {phrases.TOP}""",
    "op5_decontamination": f"""
        WITH item AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
        test AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS gram
            FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
        doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        grams AS (
            SELECT r, n, i, list_slice(w, i, i + n - 1) AS gram
            FROM doc, (SELECT DISTINCT n FROM test) AS lengths, unnest(range(1, len(w) - n + 2)) AS u(i)),
        hits AS (SELECT r, i, grams.n, item FROM grams JOIN test USING (n, gram)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY r),
        items AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
            coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
}
