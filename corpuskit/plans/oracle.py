"""DuckDB statements that state the expected result of each registered query.

They are written from the operator specifications, not from the Spark code: windows
where the Spark side aggregates, recursive CTEs where it folds, lag/lead where it
computes neighbour ids. Views ``documents, pages, embeddings, benchmark, conversations,
events, labels, part`` are expected to exist.
"""

from __future__ import annotations

from corpuskit.operators.prompts import QA_TEMPLATE

SIZE, OVERLAP, STEP = 512, 64, 448
DIM = 64


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
ENTITY_CHAIN = [("&quot;?", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;?", " "), ("&copy;?", "©"),
                ("&reg;?", "®"), ("&middot;?", "·"), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")]


def _decode(x: str) -> str:
    for pat, rep in ENTITY_CHAIN:
        x = f"regexp_replace({x}, {_q(pat)}, {_q(rep)}, 'g')"
    return x


def _strip(x: str) -> str:
    return STRIP.format(x=x)


def _html_text(x: str) -> str:
    for pat in [r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>",
                r"(?is)<head\b.*?</head\s*>", r"<[a-zA-Z/!][^>]*>"]:
        x = f"regexp_replace({x}, {_q(pat)}, chr(1), 'g')"
    x = f"regexp_replace({x}, '\\x01+', chr(10), 'g')"
    x = _decode(x)
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(x)


def _title(x: str) -> str:
    return _strip(_decode(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)"))


# window chunks of a (doc_id, text) relation named {src}
def _chunk_ctes(src: str) -> str:
    return f"""
ck_t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS toks, * EXCLUDE (doc_id) FROM {src}),
ck_n AS (SELECT *, CASE WHEN len(toks) = 0 THEN 0 WHEN len(toks) <= {SIZE} THEN 1
                        ELSE CAST(ceil((len(toks) - {SIZE}) / {STEP}.0) AS INTEGER) + 1 END AS n_chunks FROM ck_t),
ck_i AS (SELECT *, unnest(range(0, n_chunks)) AS i FROM ck_n),
chunks AS (SELECT CAST(doc_id AS VARCHAR) || '#' || CAST(i AS VARCHAR) AS chunk_id, doc_id,
                  CAST(i AS INTEGER) AS chunk_index, CAST(n_chunks AS INTEGER) AS n_chunks,
                  array_to_string(list_slice(toks, i * {STEP} + 1, i * {STEP} + {SIZE}), ' ') AS ctext,
                  CAST(len(list_slice(toks, i * {STEP} + 1, i * {STEP} + {SIZE})) AS INTEGER) AS n_tokens,
                  * EXCLUDE (doc_id, toks, n_chunks, i, text)
           FROM ck_i)"""


# hashed bag-of-terms of relation {src}({key}, {txt}) as long rows (key, bucket, w)
def _hash_ctes(prefix: str, src: str, key: str, txt: str) -> str:
    return f"""
{prefix}_t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({txt}), '[\\pL\\pN]+')) AS term FROM {src}),
{prefix}_b AS (SELECT k, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS INTEGER) AS bucket,
                      count(*) AS cnt FROM {prefix}_t GROUP BY k, bucket),
{prefix}_n AS (SELECT k, sqrt(sum(cnt * cnt)) AS norm FROM {prefix}_b GROUP BY k),
{prefix}_w AS (SELECT b.k, b.bucket, b.cnt / n.norm AS w FROM {prefix}_b b JOIN {prefix}_n n USING (k)),
{prefix}_v AS (SELECT k, list(coalesce(w.w, 0.0) ORDER BY g.bucket) AS vec
               FROM (SELECT DISTINCT k FROM {src_keys(src, key)}) ks
               CROSS JOIN (SELECT CAST(range AS INTEGER) AS bucket FROM range(0, {DIM})) g
               LEFT JOIN {prefix}_w w USING (k, bucket)
               GROUP BY k)"""


def src_keys(src: str, key: str) -> str:
    return f"(SELECT {key} AS k FROM {src})"


def _topk(qv: str, cv: str, k: int) -> str:
    """Top-k of question vectors {qv}(k, vec) over chunk vectors {cv}(cid, vec)."""
    return f"""
pairs AS (SELECT q.k AS question_id, c.cid,
                 list_sum(list_transform(range(1, {DIM} + 1), lambda i: (q.vec[i] - c.vec[i]) * (q.vec[i] - c.vec[i]))) AS d
          FROM {qv} q CROSS JOIN {cv} c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(d, 9), cid) AS rank FROM pairs),
hits AS (SELECT question_id, cid, d, exp(-d) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k})"""


_UNIQ_DOCS = """
uniq AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1)"""


def _retrieval(k: int) -> str:
    return f"""WITH {_UNIQ_DOCS},
{_chunk_ctes('uniq')},
{_hash_ctes('qh', 'benchmark', 'item_id', 'text')},
{_hash_ctes('chh', 'chunks', 'chunk_id', 'ctext')},
cvec AS (SELECT k AS cid, vec FROM chh_v),
{_topk('qh_v', 'cvec', k)}"""


def _mail_raw() -> str:
    mid = ("CASE WHEN turn % 5 = 0 THEN 'fallback-' || sha1(role || ' ' || CAST(turn AS VARCHAR) || '|' || "
           "'\"' || role || '\" <' || role || '@example.org>' || '|' || 'Mon, 01 Jan 2024 00:00:00 +0000') "
           "ELSE '<' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) || '@example.org>' END")
    body = _strip("coalesce(text, '')")
    return f"""
raw0 AS (SELECT role AS folder, conv_id * 1000 + turn AS seq, conv_id, turn, role, text FROM conversations
         UNION ALL
         SELECT 'archive', conv_id * 1000 + turn, conv_id, turn, role, text FROM conversations WHERE turn % 7 = 0),
mail AS (SELECT folder, seq, conv_id, text AS src_text, {mid} AS doc_id, role || ' ' || CAST(turn AS VARCHAR) AS subject,
                role || '@example.org' AS from_addr, role AS from_name, 'list@example.org' AS to_addr,
                'Mon, 01 Jan 2024 00:00:00 +0000' AS date,
                'Subject: ' || role || ' ' || CAST(turn AS VARCHAR) || chr(10) || 'From: \"' || role || '\" <' || role
                || '@example.org>' || chr(10) || 'To: list@example.org' || chr(10)
                || 'Date: Mon, 01 Jan 2024 00:00:00 +0000' || chr(10) || 'Folder: ' || folder || chr(10) || chr(10)
                || {body} AS text
         FROM raw0)"""


def _mail_select(limit: int | None) -> str:
    lim = "" if limit is None else f"WHERE rn_folder <= {limit}"
    return f"""WITH {_mail_raw()},
ord AS (SELECT * FROM (VALUES ('user', 0), ('assistant', 1), ('system', 2), ('archive', 3), ('Sent', 4)) t(folder, folder_ord)),
inord AS (SELECT m.*, o.folder_ord, row_number() OVER (PARTITION BY m.folder ORDER BY m.seq DESC) AS rn_folder
          FROM mail m JOIN ord o USING (folder)),
limited AS (SELECT * FROM inord {lim}),
known AS (SELECT '<' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) || '@example.org>' AS id
          FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels)),
fresh AS (SELECT * FROM limited WHERE doc_id NOT IN (SELECT id FROM known)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY folder_ord, seq) AS rn FROM fresh)
SELECT doc_id, folder, seq, subject, sha1(text) AS text_sha1 FROM firsts WHERE rn = 1"""


def _model_fold(src: str) -> str:
    """Step-rounded running mean per model over {src}(model, ts, event_id, x)."""
    return f"""WITH RECURSIVE ev AS (
    SELECT model, x, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS n FROM ({src}) s),
fold(model, n, m) AS (
    SELECT model, n, round_even(x, 0) FROM ev WHERE n = 1
    UNION ALL
    SELECT f.model, f.n + 1, round_even((f.m * f.n + e.x) / (f.n + 1), 0)
    FROM fold f JOIN ev e ON e.model = f.model AND e.n = f.n + 1),
stats AS (SELECT model, CAST(max(n) AS BIGINT) AS runs, CAST(arg_max(m, n) AS DOUBLE) AS avg_ttft_ms
          FROM fold GROUP BY model)"""


def _prompt_parts():
    head, rest = QA_TEMPLATE.split("{context}")
    mid, tail = rest.split("{question}")
    return _q(head), _q(mid), _q(tail)


def _prompts_sql() -> str:
    head, mid, tail = _prompt_parts()
    budget = 4096 - 1024
    return _retrieval(8) + f""",
joined AS (SELECT h.question_id, h.rank, c.ctext, c.n_tokens FROM hits h JOIN chunks c ON c.chunk_id = h.cid),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tot
        FROM joined),
kept AS (SELECT * FROM run WHERE rank = 1 OR tot <= {budget}),
prompts AS (SELECT k.question_id, count(*) AS n_chunks, CAST(sum(least(n_tokens, {budget})) AS BIGINT) AS context_tokens,
                   {head} || string_agg(ctext, chr(10) || chr(10) ORDER BY rank) || {mid} || any_value(b.text) || {tail} AS prompt
            FROM kept k JOIN benchmark b ON b.item_id = k.question_id GROUP BY k.question_id)"""


ORACLE = {
    "dedupe_first_text": f"""WITH {_UNIQ_DOCS}
SELECT doc_id, lang, source, n_chars, sha1(text) AS text_sha1 FROM uniq""",

    "skip_existing": """SELECT doc_id, lang, source, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",

    "file_doc_ids": """SELECT doc_id,
  sha1(source || '|' || (CASE WHEN doc_id = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END) || '|' || sha1(text)) AS file_doc_id,
  CASE WHEN doc_id = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS page
FROM documents""",

    "ingest_report": f"""WITH u AS (
  SELECT doc_id, text, count(*) OVER (PARTITION BY sha1(text)) AS dup,
         row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT u.*, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = u.doc_id) AS ex,
             len(regexp_extract_all(text, '\\S+')) AS nt FROM u WHERE rn = 1)
SELECT CAST(sum(dup) AS BIGINT) AS docs_loaded, CAST(count(*) AS BIGINT) AS docs_unique,
       CAST(count(*) FILTER (WHERE ex) AS BIGINT) AS docs_existing,
       CAST(count(*) FILTER (WHERE NOT ex) AS BIGINT) AS docs_new,
       CAST(coalesce(sum(CASE WHEN ex OR nt = 0 THEN 0 WHEN nt <= {SIZE} THEN 1
                     ELSE ceil((nt - {SIZE}) / {STEP}.0) + 1 END), 0) AS BIGINT) AS chunks
FROM f""",

    "window_chunks": f"""WITH {_chunk_ctes('documents')}
SELECT chunk_id, doc_id, chunk_index, n_chunks, n_tokens, sha1(ctext) AS text_sha1 FROM chunks""",

    "chunk_neighbours": f"""WITH {_chunk_ctes('documents')}
SELECT chunk_id,
       lag(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev_chunk_id,
       lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS next_chunk_id
FROM chunks""",

    "merge_metadata": f"""WITH {_chunk_ctes('documents')}
SELECT chunk_id, 'file_path' AS key, source AS value FROM chunks
UNION ALL SELECT chunk_id, 'lang', lang FROM chunks
UNION ALL SELECT chunk_id, 'chunk_index', CAST(chunk_index AS VARCHAR) FROM chunks
UNION ALL SELECT chunk_id, 'source_type', 'chunk' FROM chunks
UNION ALL SELECT chunk_id, 'doc_id', CAST(doc_id AS VARCHAR) FROM chunks""",

    "page_title": f"SELECT page_id, {_title('html')} AS title FROM pages",

    "page_text": f"""SELECT page_id, sha1(t) AS text_sha1, CAST(length(t) AS BIGINT) AS n_chars
FROM (SELECT page_id, {_html_text('html')} AS t FROM pages)""",

    "page_documents": f"""SELECT page_id, sha1(url) AS doc_id,
       replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '.html', '') AS slug,
       title, sha1('Title: ' || title || chr(10) || chr(10) || body) AS text_sha1
FROM (SELECT page_id, url, {_title('html')} AS title, {_html_text('html')} AS body FROM pages)
WHERE regexp_matches(body, '\\S')""",
}

_LINKS = """WITH l AS (
  SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS origin,
         regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS hrefs FROM pages),
e AS (SELECT page_id, origin, CAST(i - 1 AS INTEGER) AS pos, hrefs[i] AS href
      FROM l, LATERAL (SELECT unnest(range(1, len(hrefs) + 1)) AS i)),
m AS (SELECT page_id, origin || href AS link, min(pos) AS pos FROM e WHERE regexp_matches(href, '^/[^/]+$')
      GROUP BY page_id, origin || href)"""

ORACLE["page_links"] = _LINKS + "\nSELECT page_id, pos, link FROM m"
ORACLE["first_links"] = _LINKS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM m)
SELECT page_id, pos, link FROM r WHERE rn <= 3"""

ORACLE["mail_documents"] = f"""WITH {_mail_raw()}
SELECT doc_id, doc_id AS message_id, subject, from_addr, from_name, to_addr, date, folder, sha1(text) AS text_sha1
FROM mail"""
ORACLE["mbox_documents"] = f"""WITH {_mail_raw()}
SELECT doc_id, subject, 'mbox' AS folder,
       sha1('Subject: ' || subject || chr(10) || 'From: "' || from_name || '" <' || from_addr || '>' || chr(10)
            || 'To: list@example.org' || chr(10) || 'Date: ' || date || chr(10) || 'Folder: mbox' || chr(10) || chr(10)
            || {_strip("regexp_replace(coalesce(src_text, ''), '(?m)^From ', '>From ', 'g')")}) AS text_sha1
FROM mail WHERE folder <> 'archive'"""
ORACLE["mime_documents"] = f"""WITH m AS (
  SELECT '<m' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) || '@example.org>' AS doc_id,
         'Ré: ' || role || ' ' || CAST(turn AS VARCHAR) AS subject, role, turn, coalesce(text, '') AS t FROM conversations),
b AS (SELECT *, {_strip("CASE WHEN turn % 3 = 2 THEN CASE WHEN t = '' THEN '' ELSE t || chr(10) END || 'second part' ELSE t END")} AS body
      FROM m)
SELECT doc_id, subject, 'Jürgen' AS from_name, role || '@example.org' AS from_addr, role AS folder,
       sha1('Subject: ' || subject || chr(10) || 'From: Jürgen <' || role || '@example.org>' || chr(10)
            || 'To: list@example.org' || chr(10) || 'Date: Mon, 01 Jan 2024 00:00:00 +0000' || chr(10)
            || 'Folder: ' || role || chr(10) || chr(10) || body) AS text_sha1
FROM b"""
ORACLE["text_file_documents"] = """SELECT item_id, sha1(text || chr(10)) AS text_sha1, '' AS page, 'document' AS source_type,
       true AS id_is_of_path_and_text
FROM benchmark WHERE text IS NOT NULL"""
ORACLE["embed_quarantine"] = f"""WITH {_chunk_ctes('documents')}
SELECT chunk_id, CASE WHEN ctext NOT LIKE 'T%' THEN CAST(length(ctext) AS BIGINT) ELSE -1 END AS n_chars,
       CASE WHEN ctext LIKE 'T%' THEN 'ValueError: begins with T' END AS error
FROM chunks"""
ORACLE["mail_select"] = _mail_select(None)
ORACLE["mail_newest"] = _mail_select(50)
ORACLE["mail_folders"] = f"""WITH {_mail_raw()}
SELECT DISTINCT folder FROM mail"""

ORACLE["hash_embed"] = f"""WITH {_hash_ctes('dh', 'documents', 'doc_id', 'text')}
SELECT k AS doc_id, bucket, round(w, 6) AS weight FROM dh_w"""

ORACLE["exact_top_k"] = f"""WITH {_hash_ctes('qh', 'benchmark', 'item_id', 'text')},
ev AS (SELECT vec_id AS cid, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
{_topk('qh_v', 'ev', 5)}
SELECT question_id, rank, cid AS vec_id, round(d, 6) AS distance, round(score, 6) AS score FROM hits"""

ORACLE["retrieve_sources"] = _retrieval(5) + """
SELECT h.question_id, h.rank, h.cid AS chunk_id, c.doc_id, round(h.d, 6) AS distance, round(h.score, 6) AS score,
       '(score=' || printf('%.3f', h.score) || ') ' || c.source AS label, substr(c.ctext, 1, 400) AS snippet
FROM hits h JOIN chunks c ON c.chunk_id = h.cid"""

ORACLE["build_prompts"] = _prompts_sql() + """
SELECT question_id, CAST(n_chunks AS BIGINT) AS n_chunks, context_tokens, sha1(prompt) AS prompt_sha1,
       CAST(length(prompt) AS BIGINT) AS prompt_chars FROM prompts"""

ORACLE["answer_batch"] = _prompts_sql() + """
SELECT question_id, 'len=' || CAST(length(prompt) AS VARCHAR) AS answer FROM prompts"""

SUBWORD = r"[A-Za-z]{1,6}|[0-9]{1,3}|[^\x20\x09-\x0DA-Za-z0-9]"
_HEAD, _REST = QA_TEMPLATE.split("{context}")
_MIDDLE, _TAIL = _REST.split("{question}")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE["token_chunks"] = f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{SUBWORD}')) AS BIGINT) AS n_tokens,
       true AS within, true AS counted, true AS whole
FROM documents WHERE regexp_matches(text, '{SUBWORD}')"""

ORACLE["charged_prompts"] = f"""WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rank, coalesce(text, '') AS text, role, turn
  FROM conversations),
head AS (SELECT {_literal(_HEAD)} AS head, {_literal(_MIDDLE)} AS middle, {_literal(_TAIL)} AS tail),
q AS (
  SELECT conv_id, text AS question, greatest(160 - len(regexp_extract_all(head || ' ' || middle || ' ' || tail, '{SUBWORD}'))
         - len(regexp_extract_all(text, '{SUBWORD}')), 0) AS room FROM t, head WHERE rank = 0),
s AS (
  SELECT conv_id, rank, CASE WHEN role IS NULL THEN '' ELSE 'role: ' || role || chr(10) END || 'turn: ' || turn || chr(10)
         || chr(10) || text AS shown FROM t WHERE rank > 0),
c AS (SELECT *, len(regexp_extract_all(shown, '{SUBWORD}')) AS cost FROM s),
r AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY rank) AS so_far FROM c JOIN q USING (conv_id)),
f AS (
  SELECT conv_id, question, rank, rank = 1 OR so_far <= room AS fits, least(cost, room) AS n,
         CASE WHEN rank = 1 AND cost > room THEN array_to_string(
           regexp_extract_all(shown, '[\\x20\\x09-\\x0D]*(?:{SUBWORD})')[1:room], '') ELSE shown END AS part FROM r),
p AS (
  SELECT conv_id, count(*) FILTER (fits) AS n_chunks, count(*) FILTER (NOT fits) AS n_dropped,
         CAST(sum(n) FILTER (fits) AS BIGINT) AS context_tokens, any_value(question) AS question,
         string_agg(part, chr(10) || chr(10) ORDER BY rank) FILTER (fits) AS context FROM f GROUP BY conv_id),
o AS (SELECT *, head || context || middle || question || tail AS prompt FROM p, head)
SELECT conv_id, n_chunks, n_dropped, context_tokens,
       CAST(len(regexp_extract_all(prompt, '{SUBWORD}')) AS BIGINT) AS prompt_tokens, sha1(prompt) AS prompt_sha1 FROM o"""

ORACLE["chat_messages"] = """SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages,
       sha1(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS transcript_sha1
FROM conversations GROUP BY conv_id"""

ORACLE["cumulative_text"] = """SELECT conv_id, turn, CAST(length(so_far) AS BIGINT) AS cum_chars, sha1(so_far) AS cum_sha1
FROM (SELECT conv_id, turn, string_agg(text, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
      FROM conversations WHERE coalesce(text, '') <> '')"""

ORACLE["token_stream"] = """WITH last AS (
  SELECT conv_id, coalesce(text, '') AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1)
SELECT conv_id, CAST(len(regexp_extract_all(t, '[^ ]+ *|^ +')) + 1 AS BIGINT) AS n_deltas, sha1(t) AS text_sha1,
       regexp_matches(t, '\\S') AS timed
FROM last"""

ORACLE["first_token_latency"] = """SELECT user_id, count(*) AS n_events,
       (epoch_us(min(ts) FILTER (WHERE event_type <> 'view')) - epoch_us(min(ts))) / 1000.0 AS ttft_ms
FROM events GROUP BY user_id"""

ORACLE["model_latency"] = _model_fold(
    "SELECT event_type AS model, ts, event_id, value AS x FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL"
) + "\nSELECT model, runs, avg_ttft_ms FROM stats"

ORACLE["model_latency_exact"] = """SELECT event_type AS model, count(*) AS runs, round(avg(value), 6) AS avg_ttft_ms
FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type"""

ORACLE["models_with_stats"] = _model_fold(
    "SELECT 'model-' || CAST(user_id AS VARCHAR) AS model, ts, event_id, value AS x FROM events WHERE value IS NOT NULL"
) + """
SELECT 'model-' || CAST(p_partkey AS VARCHAR) AS name,
       round_even((CAST(round(p_retailprice * 1e7) AS BIGINT) + p_partkey) / 1e9, 1) AS size_gb,
       s.avg_ttft_ms, coalesce(s.runs, 0) AS runs
FROM part LEFT JOIN stats s ON s.model = 'model-' || CAST(p_partkey AS VARCHAR)"""

ORACLE["stored_doc_ids"] = """SELECT DISTINCT source AS collection, CAST(doc_id AS VARCHAR) AS doc_id
FROM documents WHERE len(regexp_extract_all(text, '\\S+')) > 0"""

ORACLE["ingest_documents"] = f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, chunk_id, CAST(n_tokens AS BIGINT) AS n_tokens
FROM ({ORACLE["window_chunks"]})"""

# documents of one text are one, under the least id as text; stored vectors are single precision
_STORED_DOCS = """
uniq AS (SELECT * EXCLUDE (rn) FROM (
    SELECT doc_id, text, row_number() OVER (PARTITION BY sha1(text) ORDER BY CAST(doc_id AS VARCHAR)) AS rn FROM documents)
  WHERE rn = 1)"""


def _asked_sql() -> str:
    head, mid, tail = _prompt_parts()
    budget = 4096 - 1024
    return f"""WITH {_STORED_DOCS},
{_chunk_ctes('uniq')},
{_hash_ctes('qh', 'benchmark', 'item_id', 'text')},
{_hash_ctes('chh', 'chunks', 'chunk_id', 'ctext')},
cvec AS (SELECT k AS cid, CAST(CAST(vec AS FLOAT[]) AS DOUBLE[]) AS vec FROM chh_v),
{_topk('qh_v', 'cvec', 8)},
joined AS (SELECT h.question_id, h.rank, h.cid, 'doc_id: ' || CAST(c.doc_id AS VARCHAR) || chr(10) || chr(10) || c.ctext AS shown,
                  c.n_tokens FROM hits h JOIN chunks c ON c.chunk_id = h.cid),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tot
        FROM joined),
prompts AS (SELECT r.question_id,
                   {head} || string_agg(shown, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE rank = 1 OR tot <= {budget})
                   || {mid} || any_value(b.text) || {tail} AS prompt,
                   CAST(count(*) AS INTEGER) AS n_sources, string_agg(cid, ',' ORDER BY rank) AS sources
            FROM run r JOIN benchmark b ON b.item_id = r.question_id GROUP BY r.question_id)
SELECT question_id, 'len=' || CAST(length(prompt) AS VARCHAR) AS answer, CAST(NULL AS VARCHAR) AS answer_error, n_sources,
       sources FROM prompts"""


ORACLE["ask_documents"] = _asked_sql()

ORACLE["indexed_top_k"] = f"""WITH {_STORED_DOCS},
{_chunk_ctes('uniq')}
SELECT item_id AS question_id, least(5, (SELECT count(*) FROM chunks)) AS n_hits, true AS recall_reached, true AS share_kept
FROM benchmark"""

ORACLE["ingest_resume"] = f"""WITH p AS (
  SELECT sha1(url) AS doc_id, 'Title: ' || title || chr(10) || chr(10) || body AS text
  FROM (SELECT url, {_title('html')} AS title, {_html_text('html')} AS body FROM pages) WHERE regexp_matches(body, '\\S')),
src AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents UNION ALL SELECT doc_id, min(text) FROM p GROUP BY doc_id),
{_chunk_ctes('src')}
SELECT doc_id, count(*) AS n_chunks, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, 'True,0,0,1' AS seen FROM chunks GROUP BY doc_id"""

ORACLE["stream_ingest"] = ORACLE["ingest_documents"]
ORACLE["stream_latency"] = ORACLE["model_latency"]
ORACLE["stream_text"] = ORACLE["cumulative_text"]

ORACLE["stored_metadata"] = f"""WITH p AS ({ORACLE["page_documents"]}),
d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents WHERE len(regexp_extract_all(text, '\\S+')) > 0)
SELECT 'documents' AS collection, doc_id, k AS key, v AS value FROM (
  SELECT doc_id, unnest(['doc_id', 'lang', 'file_path', 'source_type']) AS k, unnest([doc_id, lang, source, 'document']) AS v FROM d)
UNION
SELECT 'paulgraham', doc_id, k, v FROM (
  SELECT doc_id, unnest(['doc_id', 'slug', 'title', 'source_type']) AS k, unnest([doc_id, slug, title, 'paulgraham']) AS v FROM p)"""

ORACLE["approx_top_k"] = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
centre AS (
  SELECT label, list(m ORDER BY i) AS vec
  FROM (SELECT label, i, avg(vec[i]) AS m FROM e, range(1, {DIM} + 1) AS r(i) GROUP BY label, i) GROUP BY label),
near AS (
  SELECT vec_id, c.label AS cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(
    list_sum(list_transform(range(1, {DIM} + 1), lambda i: (e.vec[i] - c.vec[i]) * (e.vec[i] - c.vec[i]))), 9), c.label) AS n
  FROM e CROSS JOIN centre c),
pairs AS (
  SELECT q.vec_id AS question_id, x.vec_id AS cid,
         list_sum(list_transform(range(1, {DIM} + 1), lambda i: (q.vec[i] - x.vec[i]) * (q.vec[i] - x.vec[i]))) AS d
  FROM e q JOIN near probe ON probe.vec_id = q.vec_id AND probe.n <= 8 JOIN near own ON own.cell = probe.cell AND own.n = 1
  JOIN e x ON x.vec_id = own.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(d, 9), cid) AS rank FROM pairs)
SELECT question_id, CAST(rank AS INTEGER) AS rank, cid AS vec_id, round(d, 6) AS distance, round(exp(-d), 6) AS score
FROM ranked WHERE rank <= 5"""

ORACLE["list_collections"] = """SELECT CASE WHEN lower(source) IN ('emails', 'email') THEN 'emails'
            WHEN lower(source) IN ('paulgraham', 'paul_graham', 'pg') THEN 'paulgraham' ELSE source END AS collection,
       count(*) AS n_documents
FROM documents GROUP BY 1"""

ORACLE["canonical_collection"] = """SELECT name,
       CASE WHEN lower(name) IN ('emails', 'email') THEN 'emails'
            WHEN lower(name) IN ('paulgraham', 'paul_graham', 'pg') THEN 'paulgraham' ELSE name END AS collection,
       CASE WHEN lower(name) IN ('emails', 'email') THEN 'email'
            WHEN lower(name) IN ('paulgraham', 'paul_graham', 'pg') THEN 'web' ELSE 'text' END AS kind
FROM (SELECT source AS name FROM documents UNION SELECT role FROM conversations
      UNION SELECT CASE role WHEN 'user' THEN 'Email' WHEN 'assistant' THEN 'PG' ELSE 'Paul_Graham' END FROM conversations)"""


# ------------------------------------------------------------------ sentence chunks (G1)
# Written from the G1 specification: lossless splits (a marker after every split point),
# levels applied only to pieces over the size, then a recursive greedy packing in which
# the carried overlap is the smallest suffix start whose token sum fits the overlap and
# leaves room for the next piece.
_WS = " \\t\\n\\x0b\\f\\r"
_TOK = f"[^{_WS}]+"
_G1_LEVELS = [r"\n\n\n+", f"(?:[.!?]+[\"')\\]]*[{_WS}]+|。[{_WS}]*)", f"[,.;:!?。，；！？]+[{_WS}]*",
              f"[^{_WS}]+[{_WS}]*"]


def _ntok(x: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(_TOK)}))"


def _split_level(src: str, pat: str) -> str:
    parts = f"list_filter(string_split(regexp_replace(piece, {_q('(' + pat + ')')}, '\\1' || chr(2), 'g'), chr(2)), lambda s: s <> '')"
    return f"""SELECT doc_id, piece, ord FROM {src} WHERE {_ntok('piece')} <= {SIZE}
    UNION ALL
    SELECT doc_id, piece, list_append(ord, i) AS ord FROM (
        SELECT doc_id, ord, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, ord, {parts} AS parts FROM {src} WHERE {_ntok('piece')} > {SIZE}))"""


def _sentence_sql() -> str:
    levels = ",\n".join(f"g{i + 1} AS ({_split_level(f'g{i}', p)})" for i, p in enumerate(_G1_LEVELS))
    text_of = "array_to_string(list_transform({x}, lambda e: e.t), '')"
    return f"""WITH RECURSIVE g0 AS (SELECT doc_id, coalesce(text, '') AS piece, [1] AS ord FROM documents),
{levels},
units AS (SELECT doc_id, piece, CAST({_ntok('piece')} AS BIGINT) AS n,
                 row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS idx FROM g4),
nunits AS (SELECT doc_id, max(idx) AS cnt FROM units GROUP BY doc_id),
pack(doc_id, idx, cur, cur_n, emitted) AS (
    SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(t VARCHAR, n BIGINT)[]), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR)
    FROM nunits
    UNION ALL
    SELECT doc_id, idx + 1,
           CASE WHEN closes THEN list_append(CASE WHEN j IS NULL THEN CAST([] AS STRUCT(t VARCHAR, n BIGINT)[])
                                                  ELSE list_slice(cur, j, len(cur)) END, {{'t': piece, 'n': n}})
                ELSE list_append(cur, {{'t': piece, 'n': n}}) END,
           CASE WHEN closes THEN coalesce(ss[j], 0) + n ELSE cur_n + n END,
           CASE WHEN closes THEN {text_of.format(x='cur')} END
    FROM (SELECT *, CASE WHEN closes THEN list_filter(range(1, len(cur) + 1),
                         lambda k: ss[k] <= {OVERLAP} AND ss[k] + n <= {SIZE})[1] END AS j
          FROM (SELECT *, CASE WHEN closes THEN list_transform(range(1, len(cur) + 1),
                         lambda k: list_sum(list_transform(list_slice(cur, k, len(cur)), lambda e: e.n))) END AS ss
                FROM (SELECT p.doc_id, p.idx, p.cur, p.cur_n, u.piece, u.n,
                             (p.cur_n + u.n > {SIZE} AND p.cur_n > 0) AS closes
                      FROM pack p JOIN units u ON u.doc_id = p.doc_id AND u.idx = p.idx + 1)))
),
emits AS (SELECT doc_id, idx AS pos, emitted AS chunk FROM pack WHERE emitted IS NOT NULL
          UNION ALL
          SELECT p.doc_id, p.idx + 1, {text_of.format(x='p.cur')} FROM pack p
          JOIN nunits c ON c.doc_id = p.doc_id AND p.idx = c.cnt WHERE p.cur_n > 0),
stripped AS (SELECT doc_id, pos, regexp_replace(chunk, {_q(f'^[{_WS}]+|[{_WS}]+$')}, '', 'g') AS t FROM emits),
final AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index
          FROM stripped WHERE t <> '')
SELECT CAST(doc_id AS VARCHAR) || '#' || CAST(chunk_index AS VARCHAR) AS chunk_id, doc_id,
       CAST(chunk_index AS INTEGER) AS chunk_index,
       CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_chunks,
       CAST({_ntok('t')} AS INTEGER) AS n_tokens, sha1(t) AS text_sha1
FROM final"""


ORACLE["sentence_chunks"] = _sentence_sql()
