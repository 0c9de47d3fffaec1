"""The views of ``colloquy.views`` once more, in SQL for the comparison engine."""

from __future__ import annotations

from colloquy.functions.cost import CATALOGUE, PROMPT_TOKENS, ANSWER_TOKENS
from colloquy.views import MODEL_BY_PRIORITY

_PRICES = ", ".join(
    f"('{m}', '{fam}', '{prov}', '{bill}', {i}, {o}, {h}, {n})"
    for n, (m, fam, prov, bill, i, o, h) in enumerate(CATALOGUE)
)
_MODEL = " ".join(f"WHEN o_orderpriority = '{p}' THEN '{m}'" for p, m in MODEL_BY_PRIORITY)

VIEWS: dict[str, str] = {
    "jobs": """
        SELECT o_orderkey AS id, o_orderdate AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
               o_orderpriority AS mode, o_totalprice / 1000.0 AS duration_total,
               '/rec/' || o_custkey || '/' || o_orderkey || '.mp4' AS source_path,
               o_custkey AS owner_id, o_totalprice AS price
        FROM orders""",
    "seg0": """
        SELECT CAST(conv_id AS BIGINT) AS job_id, CAST(turn AS BIGINT) AS seq,
               CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' END AS speaker, text,
               CASE WHEN role = 'system' THEN 500
                    ELSE greatest(((length(text) - length(replace(text, ' ', '')) + 1) * 1000) // 3, 1000) END AS dur_ms,
               (turn % 4) * 500 AS gap_ms,
               -((conv_id * 31 + turn * 17) % 150) / 100.0 AS avg_logprob,
               ((conv_id * 7 + turn * 13) % 100) / 100.0 AS no_speech_prob,
               1.0 + ((conv_id * 11 + turn * 5) % 30) / 10.0 AS compression_ratio
        FROM conversations""",
    "segments": """
        SELECT job_id, seq, start_ms, start_ms + dur_ms AS end_ms, speaker, text,
               CAST(avg_logprob AS DOUBLE) AS avg_logprob, CAST(no_speech_prob AS DOUBLE) AS no_speech_prob,
               CAST(compression_ratio AS DOUBLE) AS compression_ratio
        FROM (SELECT *, CAST(coalesce(sum(dur_ms + gap_ms) OVER (PARTITION BY job_id ORDER BY seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM @seg0)""",
    "words": """
        SELECT job_id, seq, pos, list_extract(parts, pos + 1) AS word,
               start_ms + pos * step AS start_ms, start_ms + (pos + 1) * step AS end_ms
        FROM (SELECT *, unnest(range(len(parts))) AS pos
              FROM (SELECT job_id, seq, start_ms, string_split(text, ' ') AS parts,
                           (end_ms - start_ms) // len(string_split(text, ' ')) AS step FROM @segments))""",
    "timeline": """
        SELECT job_id, seq, event_id, event_type, props, start_ms, start_ms + dur_ms AS end_ms,
               'SPEAKER_0' || (event_id % 3) AS speaker
        FROM (SELECT user_id AS job_id, event_id, event_type, props, 100 + (event_id * 37) % 3000 AS dur_ms,
                     row_number() OVER w AS seq,
                     CAST(coalesce(sum(100 + (event_id * 37) % 3000 + (event_id * 53) % 2500) OVER (
                       PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
              FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "turns": "SELECT job_id, seq, start_ms, end_ms, speaker FROM @timeline",
    "captions": """
        SELECT job_id, seq, start_ms, end_ms,
               CASE WHEN event_id % 37 = 0 THEN '...' WHEN event_id % 41 = 0 THEN 'Sous-titrage ST 501'
                    WHEN event_id % 43 = 0 THEN 'Ok'
                    WHEN (event_id * 7) % 10 < 6 THEN 'C’est noté, merci.'
                    ELSE event_type || ' ' || props END AS text,
               CASE WHEN event_id % 29 <> 0 THEN CAST(1.0 + (event_id % 20) / 10.0 AS DOUBLE) END AS compression_ratio,
               CASE WHEN event_id % 11 <> 0 AND event_id % 5 <> 0 THEN 'SPEAKER_0' || (event_id % 2) END AS speaker,
               event_id
        FROM @timeline""",
    "turns_conv": """
        SELECT job_id, seq, start_ms + 300 AS start_ms, end_ms + 300 AS end_ms,
               'SPEAKER_0' || ((seq + 1) % 3) AS speaker FROM @segments""",
    "spans": """
        SELECT job_id, seq, src_start, src_end, trim_start, trim_start + dur AS trim_end
        FROM (SELECT job_id, seq, start_ms AS src_start, end_ms AS src_end, end_ms - start_ms AS dur,
                     CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY job_id ORDER BY seq
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS trim_start
              FROM @segments WHERE seq % 2 = 1)""",
    "vectors": "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "clusters": """
        SELECT vec_id % 20 AS job_id, 'SPEAKER_0' || (label % 10) AS speaker, vec_id, embedding
        FROM @vectors WHERE vec_id % 2 = 1""",
    "profile_vectors": "SELECT 'label_' || label AS name, vec_id, embedding FROM @vectors WHERE vec_id % 2 = 0",
    "prices": f"SELECT * FROM (VALUES {_PRICES}) t(model, family, provider, billing, cents_in, cents_out, cents_hour, position)",
    "dearest": f"""
        SELECT * FROM @prices ORDER BY CASE WHEN billing = 'per_hour' THEN cents_hour * 1000000
            ELSE cents_in * (3600 * 32 + {PROMPT_TOKENS}) + cents_out * (3600 * 10 + {ANSWER_TOKENS}) END DESC, position LIMIT 1""",
    "usage0": f"""
        SELECT o_orderdate AS created_at, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS job_id,
               o_orderkey AS usage_id, CASE {_MODEL} ELSE 'unlisted-model' END AS model,
               'step_' || (o_orderkey % 4) AS step,
               CAST(floor(o_totalprice) AS BIGINT) AS input_tokens, CAST(o_custkey * 7 AS BIGINT) AS output_tokens
        FROM orders""",
    "usage1": """
        SELECT u.*, coalesce(p.provider, d.provider) AS provider,
               input_tokens * coalesce(p.cents_in, d.cents_in) + output_tokens * coalesce(p.cents_out, d.cents_out) AS n
        FROM @usage0 u LEFT JOIN @prices p ON p.model = u.model CROSS JOIN @dearest d""",
    "api_usage": """
        SELECT created_at, job_id, usage_id, model, step, input_tokens, output_tokens, provider, cost_micro,
               cost_micro / 1000000.0 AS cost_usd
        FROM (SELECT *, CAST(n // 100 + CASE WHEN n % 100 > 50 OR (n % 100 = 50 AND (n // 100) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) AS cost_micro
              FROM @usage1)""",
    "glossary": """
        SELECT DISTINCT unnest(regexp_extract_all(text, '([A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{4,})', 1)) AS term FROM documents""",
    "page_text": r"""
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'),
              '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
            '&(?:nbsp|amp|lt|gt|quot|#\d+);', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
            '^\s+', ''), '\s+$', '') AS text
        FROM pages""",
    "corpus": """
        SELECT 'doc-' || doc_id AS source_id, text FROM documents
        UNION ALL SELECT 'page-' || page_id, text FROM @page_text""",
    "partners": """
        SELECT c_custkey AS partner_id, c_name AS name,
               lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@' || lower(n_name) || '.example' AS email,
               CASE WHEN c_custkey % 3 <> 0 THEN n_name END AS company
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "meeting_seats": """
        SELECT DISTINCT date_trunc('hour', ts) AS start_at, user_id, user_id // 6 AS room FROM events""",
    "meetings": """
        SELECT CAST(start_at AS TIMESTAMP) AS start_at, CAST(start_at AS TIMESTAMP) + INTERVAL 1 HOUR AS stop_at,
               list(user_id ORDER BY user_id) AS partner_ids,
               CAST(epoch(start_at) AS BIGINT) // 3600 * 1000000 + room AS meeting_id
        FROM @meeting_seats GROUP BY start_at, room""",
    "files": """
        SELECT p_partkey % 50 AS job_id,
               '/ws/' || (p_partkey % 50) || '/' || list_extract(['logs', 'work', 'out', 'cloud_chunks'], CAST(p_partkey % 4 + 1 AS INT))
               || '/' || replace(p_name, ' ', '_') || '-' || p_partkey
               || list_extract(['.txt', '.json', '.mp4', '.wav', '.md', '.srt', '.log'], CAST(p_partkey % 7 + 1 AS INT)) AS path,
               CAST(p_size * 1000 AS BIGINT) AS size
        FROM part""",
    "runs_terms": "SELECT l_orderkey AS run, p_name AS term FROM lineitem JOIN part ON l_partkey = p_partkey",
    "transcript_lines": r"""
        SELECT job_id, seq, '[' || coalesce(speaker, '?') || '] (' ||
               printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || ') ' ||
               regexp_replace(text, '\s+', ' ', 'g') AS line
        FROM @segments""",
}
