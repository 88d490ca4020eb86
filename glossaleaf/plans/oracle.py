"""For each query the equivalent DuckDB SQL over the same given tables."""

from __future__ import annotations

import re

from glossaleaf.functions import prompts as P
from glossaleaf.functions.text import PY_SPACE
from glossaleaf.languages import LANGUAGES
from glossaleaf.plans.queries import LOOKUP_DOC, RECURRING_WITHIN, STUCK_AFTER
from glossaleaf.sources.given import CODES, START_MICROS


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(sql: str) -> str:
    return f"trim({sql}, {lit(PY_SPACE)})"


def created_at(number: str) -> str:
    return f"make_timestamp({START_MICROS} + {number} * 977000000 + {number} % 3 * 250000)"


def iso(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN microsecond({ts}) % 1000000 = 0 THEN '' ELSE strftime({ts}, '.%f') END"
    )


def diary_key(ts: str, sep: str = "_") -> str:
    return f"(strftime({ts}, '%Y-%m-%d') || '{sep}' || {iso(ts)})"


def pick(values: list[str], index: str) -> str:
    return f"[{', '.join(lit(v) for v in values)}][({index}) + 1]"


def json_string(sql: str) -> str:
    """ASCII JSON string: DuckDB's own quoting, then \\uXXXX for the other characters."""
    body = f"CAST(to_json({sql}) AS VARCHAR)"
    escape = (
        "CASE WHEN unicode(c) < 127 THEN c WHEN unicode(c) >= 65536 THEN "
        "printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) "
        "ELSE printf('\\u%04x', unicode(c)) END"
    )
    return f"array_to_string(list_transform(string_split({body}, ''), lambda c: {escape}), '')"


def vowels(column: str, vowel: str) -> str:
    return f"(length({column}) - length(replace({column}, '{vowel}', '')))"


def json_list(sql: str) -> str:
    return f"('[' || array_to_string(list_transform({sql}, lambda e: {json_string('e')}), ', ') || ']')"


def render(template: str, **slots: str) -> str:
    pieces = re.split("(" + "|".join(re.escape("{" + s + "}") for s in slots) + ")", template)
    parts = [slots[p[1:-1]] if p[1:-1] in slots and p.startswith("{") else lit(p) for p in pieces if p]
    return " || ".join(f"({p})" for p in parts)


def message(role: str, content: str) -> str:
    return f"'{{\"role\": ' || {json_string(role)} || ', \"content\": ' || {json_string(content)} || '}}'"


LANGS = ", ".join(f"({lit(a)}, {lit(b)}, {lit(c)})" for a, b, c in LANGUAGES)
LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]
PAIR = r"<bracket>(.*?)</bracket>[\s\n]?<translation>(.*?)</translation>"
ECHO_PAIR = "'<bracket>[text]</bracket><translation>corresponding translation</translation>' || chr(10)"
NO_PAIRS = "CAST([] AS STRUCT(o VARCHAR, t VARCHAR)[])"
WORD = "replace(replace({0}, '[', ''), ']', '')"


def word(sql: str) -> str:
    return WORD.format(sql)


def hits(body: str, phrase: str) -> str:
    return f"((length({body}) - length(replace({body}, {phrase}, ''))) / length({phrase}))"


def tag(name: str) -> str:
    return f"regexp_extract_all(b, '<{name}>(.*?)</{name}>', 1, 's')[1]"


CTE = {
    "langs": f"SELECT * FROM (VALUES {LANGS}) v(alpha_3, alpha_2, name)",
    "base": f"""
        SELECT doc_id, text, source, n_chars,
            CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items())} END AS language_source,
            CASE WHEN lang = 'en' THEN 'fra' ELSE 'eng' END AS language_annotation,
            {created_at('doc_id')} AS created_at,
            {pick(LEVELS, 'n_chars % 6')} AS level_rewriting,
            CASE WHEN n_chars % 5 <> 0 THEN 'Entry ' || doc_id END AS title_diary
        FROM documents""",
    "drafts": f"""
        SELECT *, {diary_key('created_at')} AS primary_id,
            regexp_extract_all(draft, '\\[[^\\]]+\\]') AS expressions
        FROM (SELECT *, regexp_replace(text, '([^\\s,.;:|\\[\\]]{{12,}})', '[\\1]', 'g') AS draft FROM base)""",
    "submissions": f"""
        SELECT doc_id, n_chars, 'job-' || doc_id AS job_id, created_at, primary_id,
            CASE WHEN n_chars % 23 = 0 THEN '' ELSE draft END AS draft_text,
            CASE n_chars % 6 WHEN 0 THEN '' WHEN 1 THEN ' ' || language_source || chr(9) WHEN 2 THEN 'xx'
                ELSE language_source END AS lang_diary_body,
            CASE WHEN n_chars % 29 <> 0 THEN chr(10) || language_annotation END AS lang_annotation,
            CASE WHEN n_chars % 19 = 0 THEN 'D1' ELSE level_rewriting END AS level_rewriting,
            coalesce(title_diary, '') AS title_diary
        FROM drafts""",
    "submissions_checked": f"""
        SELECT *, CASE
            WHEN draft_text IS NULL OR lang_diary_body IS NULL OR lang_annotation IS NULL
                OR level_rewriting IS NULL OR title_diary IS NULL THEN 'missing field'
            WHEN draft_text = '' THEN 'Please enter some text.'
            WHEN level_rewriting NOT IN ('A1', 'A2', 'B1', 'B2', 'C1', 'C2') THEN 'invalid level'
            WHEN lang_diary_body <> '' AND lang_annotation <> ''
                AND NOT ({strip('lang_diary_body')} IN (SELECT alpha_3 FROM langs)
                    AND {strip('lang_annotation')} IN (SELECT alpha_3 FROM langs)) THEN 'unknown language'
            END AS reject_reason
        FROM submissions""",
    "translator": f"""
        SELECT *,
            CASE WHEN doc_id % 5 = 0 THEN 'You are a translator.<|assistant|>' ELSE '' END ||
            CASE WHEN doc_id % 17 = 8 THEN '' ELSE {ECHO_PAIR} END ||
            array_to_string(list_transform(
                CASE WHEN doc_id % 7 = 3 THEN expressions[1:greatest(len(expressions) - 1, 0)]
                     WHEN doc_id % 11 = 5 THEN expressions[1:1] ELSE expressions END,
                lambda x: '<bracket> ' || x || '</bracket>' || chr(10) || '<translation>t_' || {word('x')} || '</translation>'
            ), chr(10)) ||
            CASE WHEN doc_id % 13 = 6 THEN '<no_errors/> <no_errors/>' ELSE '' END AS response
        FROM drafts""",
    "tails": "SELECT *, string_split(response, '<|assistant|>')[-1] AS tail FROM translator",
    "pairs": f"""
        SELECT * EXCLUDE (found), len(expressions) AS n_expected,
            CASE WHEN len(regexp_extract_all(tail, '<no_errors/>')) > 1 THEN {NO_PAIRS}
                 WHEN len(found) = len(expressions) THEN found
                 WHEN len(found) = 1 THEN {NO_PAIRS}
                 ELSE found[2:] END AS pairs
        FROM (SELECT *, list_transform(
                list_zip(regexp_extract_all(tail, '{PAIR}', 1, 's'), regexp_extract_all(tail, '{PAIR}', 2, 's')),
                lambda z: {{'o': {strip('z[1]')}, 't': z[2]}}) AS found FROM tails)""",
    "placed": f"""
        SELECT *,
            coalesce(list_bool_and(list_transform(pairs, lambda p: {hits('draft', word('p.o'))} = 1)), true) AS placed,
            list_reduce(list_prepend({{'o': draft, 't': ''}}, pairs),
                lambda a, p: {{'o': replace(a.o, p.o, p.t), 't': ''}}).o AS replaced
        FROM pairs""",
    "translated": f"""
        SELECT * EXCLUDE (replaced), replaced, CASE WHEN translate_status = 'ok' THEN replaced ELSE '' END AS draft_replaced
        FROM (SELECT *, CASE WHEN NOT placed THEN 'position_mismatch'
            WHEN NOT coalesce(list_bool_and(list_transform(pairs, lambda p: {hits('replaced', 'p.t')} = 1)), true)
                THEN 'span_mismatch' ELSE 'ok' END AS translate_status FROM placed)""",
    "spans": f"""
        SELECT doc_id, primary_id, created_at, language_source, language_annotation, ordinal,
            p.o AS expression_original, p.t AS expression_translation,
            strpos(draft, {word('p.o')}) - 1 AS original_start,
            strpos(draft, {word('p.o')}) - 1 + length({word('p.o')}) AS original_end,
            strpos(replaced, p.t) - 1 AS translation_start,
            strpos(replaced, p.t) - 1 + length(p.t) AS translation_end
        FROM (SELECT *, unnest(pairs) AS p, generate_subscripts(pairs, 1) - 1 AS ordinal
            FROM translated WHERE translate_status = 'ok')""",
    "expressions": f"""
        SELECT sha256(primary_id || '_' || expression_original || '_' || {iso('created_at')}) AS primary_id,
            primary_id AS "primary_id_DiaryEntry", created_at, expression_original AS expression, expression_translation,
            '[' || original_start || ', ' || original_end || ']' AS span_original,
            '[' || translation_start || ', ' || translation_end || ']' AS span_translation,
            original_start, original_end, language_source, language_annotation
        FROM spans""",
    "archivist": """
        SELECT *, '<error>' || chr(10) || '  <rule>The specific rule violated</rule>' || chr(10)
            || '  <correction>The corrected phrase</correction>' || chr(10) || '</error>' || chr(10)
            || array_to_string(list_transform(expressions, lambda x:
                '<error>' || chr(10) || '  <rule> rule ' || (length(x) % 12) || '</rule>' || chr(10)
                || CASE WHEN length(x) % 9 <> 0 THEN '  <phrase>' || {w} || '</phrase>' || chr(10) ELSE '' END
                || CASE WHEN length(x) % 7 <> 0 THEN '  <correction>'
                    || CASE WHEN length(x) % 6 = 0 THEN {w} ELSE 'c_' || {w} END || '</correction>' || chr(10) ELSE '' END
                || CASE WHEN length(x) % 5 <> 0 THEN '  <category>'
                    || ['Grammar', 'Vocabulary', 'Spelling', 'Style'][length(x) % 4 + 1] || '</category>' || chr(10) ELSE '' END
                || '</error>'), chr(10))
            || CASE WHEN doc_id % 13 = 6 THEN '<no_errors/><no_errors/>' ELSE '' END AS response
        FROM drafts""".format(w=word("x")),
    "blocks": f"""
        SELECT *, list_filter(list_transform(
            CASE WHEN len(regexp_extract_all(response, '<no_errors/>')) > 1 THEN CAST([] AS VARCHAR[])
                ELSE regexp_extract_all(response, '<error>(.*?)</error>', 1, 's')[2:] END,
            lambda b: {{'rule': {strip(tag('rule'))}, 'phrase': coalesce({strip(tag('phrase'))}, ''),
                'correction': {strip(tag('correction'))}, 'category': coalesce({strip(tag('category'))}, 'None')}}),
            lambda e: e.rule IS NOT NULL AND e.correction IS NOT NULL) AS errors
        FROM archivist""",
    "errors": """
        SELECT primary_id AS "primary_id_DiaryEntry", 'model-0' AS model_id_embedding,
            CASE WHEN doc_id % 31 = 4 THEN 'xx' ELSE language_source END AS language_diary_text,
            language_annotation AS language_annotation_text, error_no, e.rule AS error_rule, e.phrase AS example_phrase,
            e.correction AS correction, e.category AS category
        FROM (SELECT *, unnest(errors) AS e, generate_subscripts(errors, 1) AS error_no FROM blocks)""",
    "errors_checked": """
        SELECT *, CASE WHEN category NOT IN ('Grammar', 'Vocabulary', 'Spelling', 'None') THEN 'category'
            WHEN language_annotation_text NOT IN (SELECT alpha_3 FROM langs) THEN 'language_annotation'
            WHEN language_diary_text NOT IN (SELECT alpha_3 FROM langs) THEN 'language_diary' END AS reject_reason
        FROM errors""",
    "good_errors": "SELECT * FROM errors_checked WHERE reject_reason IS NULL",
    "attempts": """
        SELECT doc_id, language_source, attempt,
            CASE WHEN (doc_id + attempt) % 2 = 0 THEN draft ELSE '<rewriting>rewritten text</rewriting>' || chr(10)
                || '<rewriting>' || draft || '</rewriting>' END AS response,
            CASE WHEN (doc_id + attempt) % 5 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
            CASE WHEN (doc_id + attempt) % 3 = 0 THEN 'ita' WHEN (doc_id + attempt) % 7 <> 0 THEN language_source END
                AS detected_language
        FROM (SELECT *, unnest(generate_series(1, doc_id % 7 + 1)) AS attempt FROM drafts)""",
    "classified": f"""
        SELECT *, CASE WHEN status = 'success' THEN {word('found[-1]')} ELSE response END AS rewriting
        FROM (SELECT *, CASE WHEN len(found) = 0 THEN 'xml_error' WHEN finish_reason = 'length' THEN 'insufficient_length'
            WHEN detected_language IS DISTINCT FROM language_source THEN 'incorrect_language' ELSE 'success' END AS status
            FROM (SELECT *, regexp_extract_all(response, '<rewriting>(.*?)</rewriting>', 1, 's') AS found FROM attempts))""",
    "entries": f"""
        SELECT {diary_key('created_at')} AS primary_id, doc_id, created_at, strftime(created_at, '%Y-%m-%d') AS date_diary,
            language_source, language_annotation, text AS diary_original, '' AS diary_replaced,
            'rewritten: ' || text AS diary_rewritten, level_rewriting, source AS model_id_tutor,
            coalesce(title_diary, '') AS title_diary, CASE WHEN n_chars % 4 <> 0 THEN 0 END AS current_version,
            doc_id % 10 <> 0 AS is_show
        FROM base""",
    "status_events": f"""
        SELECT 'job-' || user_id || '-' || (event_id % 3) AS job_id, {diary_key(created_at('user_id'))} AS diary_id, ts,
            CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'processing' END AS status,
            CASE WHEN event_type = 'error' THEN 'failed at ' || event_id ELSE '' END AS message
        FROM events""",
    "memory": f"""
        SELECT *, category || ' Error: ' || error_rule || '. Example: ''' || example_phrase || ''' -> ''' || correction || ''''
            AS page_content
        FROM (SELECT vec_id AS error_id, {diary_key(created_at('vec_id'))} AS "primary_id_DiaryEntry",
            'model-' || (vec_id % 2) AS model_id_embedding, {pick([*CODES.values(), 'xx'], 'label % 5')} AS language_diary_text,
            CASE WHEN label % 5 = 0 THEN 'fra' ELSE 'eng' END AS language_annotation_text,
            'rule ' || label AS error_rule, 'phrase ' || vec_id AS example_phrase, 'correction ' || vec_id AS correction,
            {pick(['Grammar', 'Vocabulary', 'Spelling', 'None'], 'label % 4')} AS category, embedding FROM embeddings)""",
    "near": """
        SELECT q.error_id AS query_id, m.error_id, m.page_content, list_sum(list_transform(
            list_zip(q.embedding, m.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance
        FROM memory q JOIN memory m USING (language_annotation_text, language_diary_text, model_id_embedding)
        WHERE q.error_id <> m.error_id""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, error_id) AS rank FROM near""",
    "named": """
        SELECT d.*, a.name AS diary_name, b.name AS annotation_name FROM drafts d
        LEFT JOIN langs a ON a.alpha_3 = d.language_source LEFT JOIN langs b ON b.alpha_3 = d.language_annotation""",
    "translator_prompts": f"""
        SELECT doc_id, {render(P.TRANSLATOR_SYSTEM, annotation_name='annotation_name', diary_name='diary_name')} AS system,
            {render(P.TRANSLATOR_USER, annotation_name='annotation_name', diary_name='diary_name',
                    expressions=json_list('expressions'))} AS "user" FROM named""",
    "log": """
        SELECT *, list_transform(string_split(text, ' '), lambda w: length(w)) AS output_ids FROM conversations""",
    "turns": """
        SELECT conv_id, turn, text, row_number() OVER w AS n, lag(text) OVER w AS old_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "edits": """
        SELECT conv_id, turn, old_text, text AS new_text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version_to
        FROM turns WHERE n > 1 AND old_text <> text""",
    "real_edits": f"""
        SELECT * FROM (SELECT primary_id, turn, text, lag(text) OVER (PARTITION BY primary_id ORDER BY turn) AS old FROM (
            SELECT primary_id, -1 AS turn, diary_rewritten AS text FROM entries
            UNION ALL SELECT k, turn, text FROM (SELECT {diary_key(created_at('conv_id'))} AS k, turn, text FROM conversations)
            WHERE k IN (SELECT primary_id FROM entries)))
        WHERE turn >= 0 AND old <> text""",
    "error_vectors": """
        SELECT primary_id_DiaryEntry AS primary_id, error_no, language_annotation_text, language_diary_text, model_id_embedding,
            category || ' Error: ' || error_rule || '. Example: ''' || example_phrase || ''' -> ''' || correction || '''' AS asked
        FROM good_errors WHERE example_phrase <> correction""",
    "past": f"""
        SELECT primary_id, list(page_content ORDER BY distance, page_content) AS past FROM (
            SELECT primary_id, page_content, min(distance) AS distance FROM (
                SELECT *, row_number() OVER (PARTITION BY primary_id, error_no ORDER BY distance, error_id) AS r FROM (
                    SELECT q.primary_id, q.error_no, m.error_id, m.page_content, {' + '.join(
                        f"power({vowels('asked', v)} - {vowels('page_content', v)}, 2)" for v in 'aeiou')} AS distance
                    FROM error_vectors q JOIN memory m USING (language_annotation_text, language_diary_text, model_id_embedding)))
            WHERE r <= 10 GROUP BY ALL) GROUP BY primary_id""",
    "repeated": """
        SELECT s.* EXCLUDE (job_id), job_id FROM submissions s
        UNION ALL BY NAME SELECT * REPLACE (job_id || '-again' AS job_id) FROM submissions WHERE n_chars % 10 = 1""",
    "stored_versions": """
        SELECT e.primary_id, CASE WHEN n_chars % 4 <> 0 THEN length(b.text) % 6 END AS stored FROM entries e JOIN base b USING (doc_id)""",
    "chain": f"""
        SELECT s.doc_id, s.primary_id, s.created_at, s.title_diary, s.level_rewriting, s.n_chars, s.draft_text,
            CASE WHEN lang_diary_body <> '' AND lang_annotation <> '' THEN {strip('lang_diary_body')} END AS code,
            CASE WHEN lang_diary_body <> '' AND lang_annotation <> '' THEN {strip('lang_annotation')} END AS note_code,
            t.translate_status, t.draft_replaced
        FROM submissions_checked s JOIN translated t USING (doc_id) WHERE reject_reason IS NULL""",
    "chain_chosen": f"""
        SELECT doc_id, CASE WHEN status = 'success' THEN {word('found[-1]')} ELSE response END AS rewriting FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN status IN ('success', 'insufficient_length') THEN 0 ELSE 1 END,
                CASE WHEN status IN ('success', 'insufficient_length') THEN attempt ELSE -attempt END) AS r
            FROM (SELECT *, CASE WHEN len(found) = 0 THEN 'xml_error' WHEN finish_reason = 'length' THEN 'insufficient_length'
                    WHEN detected_language IS DISTINCT FROM code THEN 'incorrect_language' ELSE 'success' END AS status
                FROM (SELECT a.*, c.code, regexp_extract_all(response, '<rewriting>(.*?)</rewriting>', 1, 's') AS found
                    FROM attempts a JOIN chain c USING (doc_id) WHERE translate_status = 'ok'))
            WHERE attempt <= 5) WHERE r = 1""",
    "review_answers": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '<review>first</review>' || chr(10) || '<review>' || text || '</review> end' END AS answer FROM drafts""",
    "grams": """
        SELECT doc_id, language_source, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
        FROM (SELECT doc_id, language_source, string_split(text, '') AS c FROM base)""",
    "gram_counts": "SELECT gram, language_source AS language, count(*) AS n FROM grams GROUP BY ALL",
    "lang_offsets": """
        SELECT language, ln(sum(n) + (SELECT count(DISTINCT gram) FROM gram_counts)) AS o FROM gram_counts GROUP BY language""",
    "lang_scores": """
        SELECT g.doc_id, l.language, sum(coalesce(ln(c.n + 1), 0) - l.o) AS score
        FROM (SELECT doc_id, gram FROM grams) g CROSS JOIN lang_offsets l
        LEFT JOIN gram_counts c ON c.gram = g.gram AND c.language = l.language GROUP BY ALL""",
    "chain_vectors": """
        SELECT q."primary_id_DiaryEntry" AS primary_id, q.error_no, c.note_code AS language_annotation_text, c.code AS language_diary_text,
            'model-0' AS model_id_embedding,
            category || ' Error: ' || error_rule || '. Example: ''' || example_phrase || ''' -> ''' || correction || '''' AS asked
        FROM errors q JOIN chain c ON c.primary_id = q."primary_id_DiaryEntry"
        WHERE translate_status = 'ok' AND code IS NOT NULL AND category IN ('Grammar', 'Vocabulary', 'Spelling', 'None')
            AND example_phrase <> correction""",
    "chain_past": f"""
        SELECT primary_id, list(page_content ORDER BY distance, page_content) AS past FROM (
            SELECT primary_id, page_content, min(distance) AS distance FROM (
                SELECT *, row_number() OVER (PARTITION BY primary_id, error_no ORDER BY distance, error_id) AS r FROM (
                    SELECT q.primary_id, q.error_no, m.error_id, m.page_content, {' + '.join(
                        f"power({vowels('asked', v)} - {vowels('page_content', v)}, 2)" for v in 'aeiou')} AS distance
                    FROM chain_vectors q JOIN memory m USING (language_annotation_text, language_diary_text, model_id_embedding)))
            WHERE r <= 10 GROUP BY ALL) GROUP BY primary_id""",
    "blank_texts": """
        SELECT doc_id, 'body' AS part, regexp_replace(draft_text, '\\[[^\\]]+\\]', '', 'g') AS t FROM chain WHERE code IS NULL
        UNION ALL SELECT doc_id, 'notes', array_to_string(regexp_extract_all(draft_text, '\\[[^\\]]+\\]'), ' ') FROM chain WHERE code IS NULL""",
    "blank_grams": """
        SELECT doc_id, part, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
        FROM (SELECT doc_id, part, string_split(t, '') AS c FROM blank_texts)""",
    "blank_scores": """
        SELECT g.doc_id, g.part, l.language, sum(coalesce(ln(c.n + 1), 0) - l.o) AS score
        FROM blank_grams g CROSS JOIN lang_offsets l
        LEFT JOIN gram_counts c ON c.gram = g.gram AND c.language = l.language GROUP BY ALL""",
    "blank_found": """
        SELECT doc_id, max(CASE WHEN part = 'body' THEN language END) AS body, max(CASE WHEN part = 'notes' THEN language END) AS notes
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY score DESC, language) AS r FROM blank_scores)
        WHERE r = 1 GROUP BY doc_id""",
}

ENTRY_LOOKUP = diary_key(created_at(f"({LOOKUP_DOC}::BIGINT)"))


def change_json(operation: str) -> str:
    return (
        f"'{{\"primary_id\":\"' || primary_id || '\",\"operation\":\"{operation}\",\"expression_original\":' "
        "|| CAST(to_json(expression) AS VARCHAR) || ',\"expression_translation\":' "
        "|| CAST(to_json(expression_translation) AS VARCHAR) || '}'"
    )


BODY = {
    "brackets": "SELECT doc_id, unnest(expressions) AS expression, CAST(generate_subscripts(expressions, 1) - 1 AS INTEGER) AS ordinal FROM drafts",
    "draft_without_brackets": "SELECT doc_id, regexp_replace(draft, '\\[[^\\]]+\\]', '', 'g') AS body, regexp_replace(draft, '\\[.+\\]', '', 'g') AS greedy_body FROM drafts",
    "annotation_text": "SELECT doc_id, array_to_string(expressions, ' ') AS annotation FROM drafts",
    "response_tail": "SELECT doc_id, tail FROM tails",
    "translation_pairs": "SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, p.o AS expression_original, p.t AS expression_translation FROM (SELECT doc_id, unnest(pairs) AS p, generate_subscripts(pairs, 1) - 1 AS ordinal FROM pairs)",
    "translate_ok": "SELECT doc_id, CAST(n_expected AS INTEGER) AS n_expected, CAST(len(pairs) AS INTEGER) AS n_parsed, translate_status FROM translated",
    "draft_replaced": "SELECT doc_id, draft_replaced FROM translated",
    "pair_spans": "SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, expression_original, expression_translation, CAST(original_start AS INTEGER) AS original_start, CAST(original_end AS INTEGER) AS original_end, CAST(translation_start AS INTEGER) AS translation_start, CAST(translation_end AS INTEGER) AS translation_end FROM spans",
    "pairs_to_expressions": "SELECT * EXCLUDE (original_start, original_end) FROM expressions",
    "expression_keys": f"SELECT primary_id AS entry, expression, sha256(primary_id || '_' || expression || '_' || {iso('created_at')}) AS expression_id FROM (SELECT primary_id, created_at, unnest(expressions) AS expression FROM drafts)",
    "span_codec": "SELECT primary_id, span_original AS span_text, CAST(original_start AS INTEGER) AS span_start, CAST(original_end AS INTEGER) AS span_end FROM expressions",
    "vocabulary": "SELECT language_annotation, expression, expression_translation, language_source FROM expressions",
    "expressions_for_entry": f'SELECT primary_id, expression, expression_translation FROM expressions WHERE "primary_id_DiaryEntry" = {ENTRY_LOOKUP}',
    "delete_expressions": 'SELECT primary_id, expression FROM expressions WHERE "primary_id_DiaryEntry" NOT IN (SELECT primary_id FROM entries WHERE NOT is_show)',
    "expression_changes": f"SELECT primary_id, {change_json('add')} AS add_change, {change_json('delete')} AS delete_change FROM expressions",
    "added_by_hand": f"SELECT primary_id AS \"primary_id_DiaryEntry\", title_diary AS expression, model_id_tutor AS expression_translation, '[-1, -1]' AS span_original, '[-1, -1]' AS span_translation, sha256(primary_id || '_' || title_diary || '_' || {iso('created_at')}) AS primary_id FROM entries WHERE is_show",
    "error_blocks": 'SELECT "primary_id_DiaryEntry", CAST(error_no AS INTEGER) AS error_no, error_rule, example_phrase, correction, category FROM errors',
    "errors_valid": "SELECT * EXCLUDE (reject_reason) REPLACE (CAST(error_no AS INTEGER) AS error_no) FROM good_errors",
    "errors_rejected": 'SELECT "primary_id_DiaryEntry", CAST(error_no AS INTEGER) AS error_no, reject_reason FROM errors_checked WHERE reject_reason IS NOT NULL',
    "errors_noop_dropped": 'SELECT "primary_id_DiaryEntry", CAST(error_no AS INTEGER) AS error_no, example_phrase, correction FROM good_errors WHERE example_phrase <> correction',
    "error_memory": "SELECT * EXCLUDE (error_no, reject_reason), category || ' Error: ' || error_rule || '. Example: ''' || example_phrase || ''' -> ''' || correction || '''' AS page_content FROM good_errors WHERE example_phrase <> correction",
    "embedded_errors": "SELECT error_id, page_content, " + ", ".join(
        f"CAST(length(page_content) - length(replace(page_content, '{v}', '')) AS FLOAT) AS v{i}" for i, v in enumerate("aeiou")) + " FROM memory",
    "errors_for_entry": 'SELECT error_id, "primary_id_DiaryEntry", model_id_embedding, language_diary_text, language_annotation_text, error_rule, example_phrase, correction, category FROM memory WHERE "primary_id_DiaryEntry" IN (SELECT primary_id FROM entries WHERE is_show) AND language_diary_text IN (SELECT alpha_3 FROM langs) AND language_annotation_text IN (SELECT alpha_3 FROM langs)',
    "errors_by_lang": "SELECT error_id, language_diary_text, error_rule FROM memory WHERE language_diary_text IN ('fra', 'spa')",
    "error_languages": "SELECT DISTINCT language_diary_text FROM memory",
    "recurring_errors": 'SELECT "primary_id_DiaryEntry", CAST(error_no AS INTEGER) AS error_no, error_rule, category FROM good_errors SEMI JOIN memory USING (language_annotation_text, language_diary_text, error_rule, category)',
    "new_errors": 'SELECT "primary_id_DiaryEntry", CAST(error_no AS INTEGER) AS error_no, error_rule, category FROM good_errors ANTI JOIN memory USING (language_annotation_text, language_diary_text, error_rule, category)',
    "similar_errors_topk": "SELECT query_id, CAST(rank AS INTEGER) AS rank, error_id, round(distance, 5) AS distance, page_content FROM ranked WHERE rank <= 10",
    "recurring_by_distance": f"SELECT m.error_id AS query_id, CASE WHEN r.distance <= {RECURRING_WITHIN} THEN 'RECURRING' ELSE 'NEW' END AS label FROM memory m LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.query_id = m.error_id",
    "rewrite_status": "SELECT doc_id, CAST(attempt AS INTEGER) AS attempt, status FROM classified",
    "rewriting_text": "SELECT doc_id, CAST(attempt AS INTEGER) AS attempt, rewriting FROM classified",
    "rewrite_attempts": """
        SELECT doc_id, CAST(attempt AS INTEGER) AS attempt, status, rewriting FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN status IN ('success', 'insufficient_length') THEN 0 ELSE 1 END,
                CASE WHEN status IN ('success', 'insufficient_length') THEN attempt ELSE -attempt END) AS r
            FROM classified WHERE attempt <= 5) WHERE r = 1""",
    "review_text": """
        SELECT doc_id, coalesce(regexp_extract_all(answer, '<review>(.*?)</review>', 1, 's')[-1], answer) AS review FROM (
            SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '<review>first</review>' || chr(10) || '<review>' || text || '</review> end' END AS answer FROM drafts)""",
    "lang_names": "SELECT doc_id, language_source, diary_name, language_annotation, annotation_name FROM named",
    "prompt_translator": "SELECT * FROM translator_prompts",
    "prompt_archivist": f"SELECT doc_id, {render(P.ARCHIVIST_SYSTEM, diary_code='language_source')} AS system, {render(P.ARCHIVIST_USER, draft='draft_replaced')} AS \"user\" FROM translated WHERE translate_status = 'ok'",
    "prompt_rewriter": f"SELECT doc_id, {render(P.REWRITER_SYSTEM, diary_name='name')} AS system, {render(P.REWRITER_USER, level='level_rewriting', diary_name='name', draft='draft_replaced')} AS \"user\" FROM translated JOIN langs ON alpha_3 = language_source WHERE translate_status = 'ok'",
    "prompt_reviewer": f"SELECT doc_id, {lit(P.REVIEWER_SYSTEM)} AS system, {render(P.REVIEWER_USER, level='level_rewriting', mistakes="CAST(to_json(list_transform(errors, lambda x: {'error_rule': x.rule, 'example_phrase': x.phrase, 'correction': x.correction, 'category': x.category})) AS VARCHAR)", history=lit('[]'), expressions=json_list('expressions'))} AS \"user\" FROM blocks",
    "prompt_reviewer_history": f"SELECT doc_id, {lit(P.REVIEWER_SYSTEM)} AS system, {render(P.REVIEWER_USER, level='level_rewriting', mistakes="CAST(to_json(list_transform(errors, lambda x: {'error_rule': x.rule, 'example_phrase': x.phrase, 'correction': x.correction, 'category': x.category})) AS VARCHAR)", history=json_list('coalesce(past, [])'), expressions=json_list('expressions'))} AS \"user\" FROM blocks LEFT JOIN past USING (primary_id)",
    "chat_payload": f"""
        SELECT doc_id, '[' || {message("'system'", 'system')} || ', ' || {message("'user'", '"user"')} || ']' AS prompt,
            CASE WHEN doc_id % 2 = 0 THEN 900 ELSE 512 END AS max_length, CAST(0.7 AS DOUBLE) AS temperature,
            doc_id % 3 <> 0 AS enable_thinking, CAST(0.9 AS DOUBLE) AS top_p FROM translator_prompts""",
    "request_bodies": f"""
        SELECT doc_id, CAST(to_json({{'prompt': '[' || {message("'system'", 'system')} || ', ' || {message("'user'", '"user"')} || ']',
                'max_length': CASE WHEN doc_id % 2 = 0 THEN 900 ELSE 512 END, 'temperature': CAST(0.7 AS DOUBLE), 'enable_thinking': true}}) AS VARCHAR) AS generate_body,
            CAST(to_json({{'model': 'tutor', 'messages': [{{'role': 'system', 'content': system}}, {{'role': 'user', 'content': "user"}}],
                'stream': false, 'options': {{'temperature': CAST(0.7 AS DOUBLE), 'num_predict': CASE WHEN doc_id % 2 = 0 THEN 900 ELSE 512 END,
                'top_p': CAST(0.9 AS DOUBLE)}}}}) AS VARCHAR) AS chat_body FROM translator_prompts""",
    "request_bodies_with_stop": f"""
        SELECT doc_id, CASE WHEN doc_id % 3 <> 0
            THEN replace(body, '"top_p":0.9}}', '"top_p":0.9,"stop":["</answer>","\\n\\n"]}}') ELSE body END AS chat_body FROM (
            SELECT doc_id, CAST(to_json({{'model': 'tutor', 'messages': [{{'role': 'system', 'content': system}}, {{'role': 'user', 'content': "user"}}],
                'stream': false, 'options': {{'temperature': CAST(0.7 AS DOUBLE), 'num_predict': 512, 'top_p': CAST(0.9 AS DOUBLE)}}}}) AS VARCHAR) AS body
            FROM translator_prompts)""",
    "chat_messages": f"SELECT conv_id, turn, {message('role', 'text')} AS message FROM conversations",
    "generated_translations": f"""
        SELECT doc_id, array_to_string(list_transform(expressions, lambda x: '<bracket>' || x || '</bracket><translation>t_' || {word('x')} || '</translation>'), '') AS response,
            'stop' AS finish_reason, CAST(len(expressions) AS INTEGER) AS completion_tokens, CAST(NULL AS VARCHAR) AS error FROM drafts""",
    "token_budget": "SELECT doc_id, CAST((length(draft) + 512) * CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS max_tokens FROM drafts",
    "task_settings": """
        SELECT doc_id, true AS translator_is_execute, CAST((length(draft_text) + 512) * CASE WHEN n_chars % 2 = 1 THEN 2 ELSE 1 END AS INTEGER) AS translator_max_tokens,
            n_chars % 2 = 1 AS translator_enable_thinking,
            true AS archivist_is_execute, CAST(length(draft_text) + 512 AS INTEGER) AS archivist_max_tokens, false AS archivist_enable_thinking,
            n_chars % 4 = 1 AS rewriter_is_execute, CAST(length(draft_text) + 512 AS INTEGER) AS rewriter_max_tokens, false AS rewriter_enable_thinking,
            n_chars % 3 = 1 AS reviewer_is_execute, CAST(length(draft_text) + 512 AS INTEGER) AS reviewer_max_tokens, false AS reviewer_enable_thinking
        FROM submissions""",
    "step_gates": """
        SELECT doc_id, CASE WHEN translate_status = 'ok' THEN 'list errors' ELSE '' END AS archivist,
            CASE WHEN translate_status = 'ok' AND n_chars % 2 = 0 THEN 'rewrite' ELSE '' END AS rewriter,
            CASE WHEN translate_status = 'ok' AND n_chars % 2 <> 0 THEN 'review' ELSE '' END AS reviewer FROM translated""",
    "response_clean": f"SELECT conv_id, turn, {strip('replace(text, string_split(text, $$.$$)[1], $$$$)')} AS answer FROM conversations",
    "finish_reason": """
        SELECT conv_id, turn, CASE WHEN output_ids[-1] = 4 THEN 'stop' WHEN len(output_ids) - least(turn + 1, len(output_ids)) >= 40 THEN 'length' ELSE 'unknown' END AS reason,
            CASE WHEN turn = 1 THEN 'length' ELSE 'stop' END AS done_reason FROM log""",
    "token_usage": """
        SELECT 'model-' || (conv_id % 3) AS model_name, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(e) AS BIGINT) AS completion_tokens, CAST(sum(p + e) AS BIGINT) AS total_tokens
        FROM (SELECT conv_id, CASE WHEN turn % 3 <> 0 THEN length(text) ELSE 0 END AS p, CASE WHEN conv_id % 4 <> 0 THEN len(output_ids) ELSE 0 END AS e FROM log) GROUP BY 1""",
    "intake_valid": f"""
        SELECT job_id, primary_id, title_diary, level_rewriting,
            CASE WHEN lang_diary_body <> '' AND lang_annotation <> '' THEN {strip('lang_diary_body')} END AS language_source,
            CASE WHEN lang_diary_body <> '' AND lang_annotation <> '' THEN {strip('lang_annotation')} END AS language_annotation
        FROM submissions_checked WHERE reject_reason IS NULL""",
    "intake_rejected": "SELECT job_id, reject_reason FROM submissions_checked WHERE reject_reason IS NOT NULL",
    "initial_status": "SELECT job_id, primary_id AS diary_id, created_at AS ts, 'processing' AS status, '' AS message FROM submissions_checked WHERE reject_reason IS NULL",
    "lang_code_invalid": f"SELECT job_id, {strip('lang_diary_body')} AS code FROM submissions WHERE {strip('lang_diary_body')} <> '' AND {strip('lang_diary_body')} NOT IN (SELECT alpha_3 FROM langs)",
    "entry_keys": f"SELECT doc_id, {diary_key('created_at')} AS run_key, {diary_key('created_at', '-')} AS record_key FROM base",
    "lang_ident": """
        SELECT b.doc_id, s.language AS detected_language FROM base b LEFT JOIN (
            SELECT doc_id, language, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS r FROM lang_scores) s
            ON s.doc_id = b.doc_id AND s.r = 1""",
    "scan_diary": "SELECT * EXCLUDE (doc_id) REPLACE (coalesce(current_version, 0) AS current_version) FROM entries",
    "append_diary": "SELECT * EXCLUDE (doc_id) REPLACE (coalesce(current_version, 0) AS current_version) FROM entries",
    "append_new_only": """
        SELECT outcome, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
            SELECT ts, CASE WHEN job_id NOT IN (SELECT job_id FROM status_events WHERE message LIKE '%7')
                AND row_number() OVER (PARTITION BY job_id ORDER BY ts) = 1 THEN 'accepted' ELSE 'refused' END AS outcome
            FROM status_events) GROUP BY outcome""",
    "append_null_order": """
        SELECT job_id, t AS ts, message, CASE WHEN job_id NOT IN (SELECT job_id FROM status_events WHERE message LIKE '%7')
            AND row_number() OVER (PARTITION BY job_id ORDER BY t NULLS FIRST, message) = 1 THEN 'accepted' ELSE 'refused' END AS outcome
        FROM (SELECT *, CASE WHEN status <> 'error' THEN ts END AS t FROM status_events)""",
    "keyed_table_rounds": """
        SELECT e.primary_id, t.draft_replaced AS diary_replaced,
            e.is_show AND e.primary_id NOT IN (SELECT diary_id FROM status_events WHERE status = 'error') AS is_show
        FROM entries e JOIN translated t USING (primary_id)
        WHERE e.primary_id NOT IN (SELECT diary_id FROM status_events WHERE status = 'completed' AND minute(ts) = 7)""",
    "stored_index_recall": "SELECT count(*) AS n_exact, true AS reached FROM ranked WHERE rank <= 10",
    "filter_diary_lang": "SELECT primary_id, language_source, language_annotation, title_diary FROM entries WHERE is_show AND language_source = 'fra' AND language_annotation = 'eng'",
    "filter_diary_visible": "SELECT primary_id, is_show, diary_original FROM entries WHERE is_show",
    "diary_list": """
        SELECT CASE j.status WHEN 'completed' THEN '✅' WHEN 'error' THEN '❌' WHEN 'processing' THEN '⏳' ELSE '❓' END AS status,
            e.primary_id, e.date_diary, e.created_at, e.title_diary, e.language_source, e.language_annotation
        FROM entries e LEFT JOIN (
            SELECT diary_id, arg_min(status, first_ts) AS status FROM (
                SELECT diary_id, job_id, min(ts) AS first_ts, arg_max(status, ts) AS status FROM status_events GROUP BY ALL)
            GROUP BY diary_id) j ON j.diary_id = e.primary_id
        WHERE e.is_show""",
    "diary_detail": """
        SELECT 'entry' AS kind, * EXCLUDE (doc_id) REPLACE (coalesce(current_version, 0) AS current_version) FROM entries WHERE is_show
        UNION ALL BY NAME SELECT 'expression' AS kind, * EXCLUDE (original_start, original_end, primary_id, "primary_id_DiaryEntry"),
            "primary_id_DiaryEntry" AS primary_id, primary_id AS item_id FROM expressions
            WHERE "primary_id_DiaryEntry" IN (SELECT primary_id FROM entries WHERE is_show)
        UNION ALL BY NAME SELECT 'error' AS kind, * EXCLUDE (error_id, embedding, "primary_id_DiaryEntry"), "primary_id_DiaryEntry" AS primary_id
            FROM memory WHERE "primary_id_DiaryEntry" IN (SELECT primary_id FROM entries WHERE is_show)""",
    "append_duplicate_keys": """
        SELECT job_id, primary_id, CASE WHEN primary_id NOT IN (SELECT primary_id FROM entries WHERE NOT is_show)
            AND row_number() OVER (PARTITION BY primary_id ORDER BY created_at, job_id) = 1 THEN 'accepted' ELSE 'refused' END AS outcome
        FROM repeated""",
    "append_expressions": "SELECT * EXCLUDE (original_start, original_end) FROM expressions",
    "append_error_memory": 'SELECT "primary_id_DiaryEntry", example_phrase, page_content, ' + ", ".join(
        f"CAST(length(page_content) - length(replace(page_content, '{v}', '')) AS FLOAT) AS v{i}" for i, v in enumerate("aeiou")) + " FROM memory",
    "edit_from_stored_version": """
        SELECT e.primary_id, CAST(CASE WHEN v.n IS NULL THEN stored ELSE coalesce(stored, 0) + v.n END AS INTEGER) AS current_version,
            CAST(CASE WHEN v.n IS NOT NULL THEN coalesce(stored, 0) END AS INTEGER) AS first_from,
            CAST(coalesce(stored, 0) + v.n AS INTEGER) AS last_to
        FROM stored_versions e LEFT JOIN (SELECT primary_id, count(*) AS n FROM real_edits GROUP BY 1) v USING (primary_id)""",
    "history_from_stored_version": """
        SELECT sha256(id || '_' || version_to) AS history_id, id AS "primary_id_DiaryEntry",
            CAST(version_to - 1 AS INTEGER) AS version_from, CAST(version_to AS INTEGER) AS version_to FROM (
            SELECT "primary_id_DiaryEntry" AS id, coalesce(stored, 0)
                + row_number() OVER (PARTITION BY "primary_id_DiaryEntry" ORDER BY created_at, e.primary_id) AS version_to
            FROM expressions e LEFT JOIN stored_versions s ON s.primary_id = "primary_id_DiaryEntry")""",
    "edit_records": f"""
        SELECT sha256(primary_id || '_' || n) AS history_id, primary_id AS "primary_id_DiaryEntry", CAST(n - 1 AS INTEGER) AS version_from,
            CAST(n AS INTEGER) AS version_to, {created_at('turn')} AS created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY primary_id ORDER BY turn) AS n FROM real_edits)""",
    "similar_errors_one_cell": "SELECT query_id, CAST(rank AS INTEGER) AS rank, error_id, round(distance, 5) AS distance FROM ranked WHERE rank <= 10",
    "job_failures": """
        SELECT job_id, primary_id AS diary_id, created_at AS ts, 'error' AS status, reject_reason AS message FROM submissions_checked
        WHERE reject_reason IS NOT NULL AND reject_reason <> 'Please enter some text.'""",
    "chain_entries": """
        SELECT c.primary_id, c.created_at, strftime(c.created_at, '%Y-%m-%d') AS date_diary, coalesce(code, 'Unknown') AS language_source,
            coalesce(note_code, 'Unknown') AS language_annotation, draft_text AS diary_original, draft_replaced AS diary_replaced,
            CASE WHEN translate_status = 'ok' AND n_chars % 4 = 1 THEN coalesce(w.rewriting, '') ELSE '' END AS diary_rewritten,
            level_rewriting, 'tutor' AS model_id_tutor, title_diary, CAST(0 AS INTEGER) AS current_version, true AS is_show
        FROM chain c LEFT JOIN chain_chosen w USING (doc_id)""",
    "chain_expressions": """
        SELECT e.* EXCLUDE (original_start, original_end) REPLACE (coalesce(code, 'Unknown') AS language_source, coalesce(note_code, 'Unknown') AS language_annotation)
        FROM expressions e JOIN chain c ON c.primary_id = e."primary_id_DiaryEntry" """,
    "chain_past_errors": f"""SELECT primary_id AS "primary_id_DiaryEntry", {json_list('past')} AS history FROM chain_past""",
    "chain_detected": """
        SELECT c.primary_id, coalesce(code, body, 'Unknown') AS language_source, coalesce(note_code, notes, 'Unknown') AS language_annotation
        FROM chain c LEFT JOIN blank_found USING (doc_id)""",
    "chain_errors": """
        SELECT e."primary_id_DiaryEntry", 'embedder' AS model_id_embedding, code AS language_diary_text, note_code AS language_annotation_text,
            error_rule, example_phrase, correction, category,
            category || ' Error: ' || error_rule || '. Example: ''' || example_phrase || ''' -> ''' || correction || '''' AS page_content
        FROM errors e JOIN chain c ON c.primary_id = e."primary_id_DiaryEntry"
        WHERE translate_status = 'ok' AND code IS NOT NULL AND category IN ('Grammar', 'Vocabulary', 'Spelling', 'None')
            AND example_phrase <> correction""",
    "chain_reviews": """
        SELECT primary_id, CASE WHEN translate_status = 'ok' AND n_chars % 3 = 1
            THEN coalesce(regexp_extract_all(answer, '<review>(.*?)</review>', 1, 's')[-1], answer) ELSE '' END AS total_review
        FROM chain JOIN review_answers USING (doc_id)""",
    "chain_status": """
        SELECT 'job-' || doc_id AS job_id, primary_id AS diary_id,
            CASE WHEN translate_status = 'span_mismatch' THEN 'error' ELSE 'completed' END AS status,
            CASE WHEN translate_status = 'span_mismatch' THEN 'Invalid extraction' ELSE '' END AS message FROM chain
        UNION ALL SELECT r.job_id, r.primary_id, 'error', coalesce(s.reject_reason, 'entry key already stored')
        FROM repeated r JOIN submissions_checked s USING (doc_id)
        WHERE (s.reject_reason IS NOT NULL AND s.reject_reason <> 'Please enter some text.')
            OR (s.reject_reason IS NULL AND r.job_id LIKE '%-again')""",
    "diary_error_join": 'SELECT e.primary_id, m.error_id, m.error_rule, m.category, e.diary_original, e.date_diary, m.language_diary_text FROM memory m JOIN entries e ON e.primary_id = m."primary_id_DiaryEntry" WHERE e.is_show',
    "soft_delete": "SELECT primary_id, is_show AND primary_id NOT IN (SELECT diary_id FROM status_events WHERE status = 'error') AS is_show, title_diary FROM entries",
    "apply_results": "SELECT e.primary_id, e.diary_original, t.draft_replaced AS diary_replaced, e.is_show FROM entries e JOIN translated t USING (primary_id)",
    "merge_latest_wins": """
        SELECT e.primary_id, coalesce(c.level_rewriting, e.level_rewriting) AS level_rewriting, coalesce(c.current_version, e.current_version, 0) AS current_version
        FROM entries e LEFT JOIN (SELECT diary_id, max(CASE WHEN status = 'completed' THEN 'C2' END) AS level_rewriting,
            CAST(arg_max(minute(ts), ts) AS INTEGER) AS current_version FROM status_events GROUP BY diary_id) c ON c.diary_id = e.primary_id""",
    "dup_keys": "SELECT job_id, count(*) AS n FROM status_events GROUP BY job_id HAVING count(*) <> 1",
    "job_status_latest": "SELECT job_id, arg_max(diary_id, ts) AS diary_id, max(ts) AS ts, arg_max(status, ts) AS status, arg_max(message, ts) AS message FROM status_events GROUP BY job_id",
    "version_numbers": "SELECT diary_id, ts, status, CAST(row_number() OVER w AS INTEGER) AS version_to, CAST(row_number() OVER w - 1 AS INTEGER) AS version_from FROM status_events WINDOW w AS (PARTITION BY diary_id ORDER BY ts)",
    "version_pairs": "SELECT conv_id, turn, new_text, old_text, CAST(version_to AS INTEGER) AS version_to, CAST(version_to - 1 AS INTEGER) AS version_from FROM edits",
    "version_edits_replayed": """
        SELECT conv_id, CAST(version_to AS INTEGER) AS version_to, new_text AS text,
            CAST(len(string_split(new_text, chr(10))) - len(string_split(old_text, chr(10))) AS BIGINT) AS more_lines FROM edits""",
    "edits_replayed": """
        SELECT primary_id, CAST(row_number() OVER (PARTITION BY primary_id ORDER BY turn) AS INTEGER) AS version_to, text FROM real_edits""",
    "version_line_changes": """
        SELECT conv_id, CAST(version_to AS INTEGER) AS version_to, CASE WHEN net > 0 THEN 'added' ELSE 'removed' END AS change, line, abs(net)::BIGINT AS n FROM (
            SELECT conv_id, n - 1 AS version_to, line, sum(sign) AS net FROM (
                SELECT conv_id, n, unnest(string_split(text, chr(10))) AS line, 1 AS sign FROM turns WHERE n > 1
                UNION ALL SELECT conv_id, n, unnest(string_split(old_text, chr(10))), -1 FROM turns WHERE n > 1) GROUP BY ALL)
        WHERE net <> 0""",
    "version_history": f"""
        SELECT sha256("primary_id_DiaryEntry" || '_' || version_to) AS history_id, "primary_id_DiaryEntry",
            CAST(version_to - 1 AS INTEGER) AS version_from, CAST(version_to AS INTEGER) AS version_to, created_at, changes FROM (
            SELECT *, {change_json('add')} AS changes, row_number() OVER (PARTITION BY "primary_id_DiaryEntry" ORDER BY created_at, primary_id) AS version_to FROM expressions)""",
    "current_versions": """
        SELECT e.primary_id, CAST(coalesce(v.n, e.current_version, 0) AS INTEGER) AS current_version, e.title_diary FROM entries e
        LEFT JOIN (SELECT "primary_id_DiaryEntry" AS id, count(*) AS n FROM expressions GROUP BY 1) v ON v.id = e.primary_id""",
    "edit_texts": """
        SELECT e.primary_id, coalesce(v.last_text, e.diary_rewritten) AS diary_rewritten,
            CAST(coalesce(v.n, e.current_version, 0) AS INTEGER) AS current_version
        FROM entries e LEFT JOIN (SELECT primary_id, count(*) AS n, arg_max(text, turn) AS last_text FROM real_edits GROUP BY 1) v
            ON v.primary_id = e.primary_id""",
    "stream_submissions": f"""
        SELECT job_id, primary_id, level_rewriting, reject_reason, CASE WHEN reject_reason IS NULL THEN 'processing' END AS status,
            CASE WHEN lang_diary_body <> '' AND lang_annotation <> '' THEN {strip('lang_diary_body')} END AS language_source
        FROM submissions_checked""",
    "stream_kept_states": f"""
        SELECT job_id, diary_id, CASE WHEN stuck THEN 'error' ELSE status END AS status,
            CASE WHEN stuck THEN 'no end within {STUCK_AFTER} minutes' ELSE message END AS message
        FROM (
            SELECT *, status = 'processing' AND epoch_ms(ts) + {STUCK_AFTER * 60_000}
                < (SELECT epoch_ms(max(ts)) FROM status_events) - 86400000 AS stuck
            FROM status_events
            QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY epoch_ms(ts) DESC, status <> 'processing' DESC, status DESC, message DESC) = 1)""",
    "stream_first_submissions": "SELECT job_id, arg_min(diary_id, ts) AS diary_id, min(ts) AS ts FROM status_events GROUP BY job_id",
    "stream_key_refusal": "SELECT job_id, arg_min(diary_id, ts) AS diary_id, min(ts) AS ts FROM status_events GROUP BY job_id",
    "stream_unique_jobs": "SELECT DISTINCT job_id, diary_id FROM status_events",
}
BODY["stream_job_status"] = BODY["job_status_latest"]
BODY |= {f"stream_chain_{name}": BODY[f"chain_{name}"] for name in ("entries", "status")}
BODY["stream_chain_memory"] = 'SELECT "primary_id_DiaryEntry", page_content, ' + ", ".join(
    f"CAST(length(page_content) - length(replace(page_content, '{v}', '')) AS FLOAT) AS v{i}" for i, v in enumerate("aeiou")
) + f" FROM ({BODY['chain_errors']})"
BODY["stream_key_sketch"] = BODY["stream_key_refusal"]
BODY["append_history"] = BODY["version_history"]
BODY["similar_errors_approx_recall"] = BODY["stored_index_recall"]
BODY["similar_errors_pruned"] = BODY["stored_index_search"] = BODY["similar_errors_one_cell"]


def _needed(sql: str) -> list[str]:
    """The named tables a statement uses, in order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in CTE.items():
            if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                found.add(name)
                todo.append(body)
    return [name for name in CTE if name in found]


def statement(name: str) -> str:
    body = BODY[name]
    named = _needed(body)
    prefix = ", ".join(f"{n} AS ({CTE[n].strip()})" for n in named)
    return f"WITH {prefix} {body.strip()}" if named else body.strip()


def statements() -> dict[str, str]:
    return {name: statement(name) for name in BODY}
