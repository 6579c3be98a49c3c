"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Payloads, digests and revisits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT html, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest, CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html"""

#: A byte's part of a crc32, eight steps of its rule; and the crc32 of a text, byte by byte.
_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM range(256) r(b))"


def _crc(text: str) -> str:
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"


_UP, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words after the damage; near ones share what is left without one character, at the same place or of the longer one; forms are followed step by step.
SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{_UP}', '{_DOWN}') AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc("doc || ':' || run")} AS h FROM counted, crc),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed) GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT a AS word, count(*) AS n_near, min({{'m': -n, 'b': b}}) AS t FROM near GROUP BY 1),
v AS (SELECT w.word, CASE WHEN -t.m >= 10 * w.n THEN t.b END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -t.m >= 10 * w.n THEN -t.m END::BIGINT AS form_n FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM v UNION ALL SELECT up.word, v.form FROM up JOIN v ON v.word = up.root WHERE v.form IS NOT NULL),
top AS (SELECT up.word, root FROM up JOIN v ON v.word = root WHERE v.form IS NULL)
SELECT v.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM v JOIN top USING (word)"""


def _best(options: list[str]) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))"


def _conversations() -> str:
    """The cheapest rest from each state of the roles (nothing, s, u, a), from each conversation's last row to its first: up
    to two added rows, then an edit of the row. Costs, audits and texts are compared as structs, in that order."""
    forced, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}

    def line(role: str, text: str, rest: str) -> str:
        return f"{role} || ':' || {text} || CASE WHEN v[{rest}].k > 0 THEN chr(10) || v[{rest}].x ELSE '' END"

    def step(cost: str, edit: str, to: int, role: str | None, text: str = "''", when: str = "true") -> str:
        rest = to + 1
        x = line(role, text, str(rest)) if role else f"v[{rest}].x"
        return f"CASE WHEN {when} THEN {{'c': {cost} + v[{rest}].c, 'a': '{edit}' || v[{rest}].a, 'x': {x}, 'k': v[{rest}].k + {int(role is not None)}}} END"

    plain = []
    for s in range(4):
        kept = {0: ("s", "u"), 1: ("u",), 2: ("a",), 3: ("u",)}[s]
        options = [step("2", "D", s, None)]
        options += [step("5 * cut", "K", {"s": 1, "u": 2, "a": 3}[r], "role", "text", f"NOT doomed AND left(role, 1) = '{r}'") for r in kept]
        options.append(step("1 + 5 * cut", "R", forced[s], f"'{name[forced[s]]}'", "text", "NOT doomed"))
        plain.append(_best(options))

    def added(s: int, n: int) -> str:
        at, lines = s, []
        for _ in range(n):
            at = forced[at]
            lines.append(f"{name[at]}:")
        p = f"p[{at + 1}]"
        return f"{{'c': {5 * n} + {p}.c, 'a': '{'I' * n}' || {p}.a, 'x': {' || chr(10) || '.join(f"'{x}'" for x in lines) + f" || CASE WHEN {p}.k > 0 THEN chr(10) || {p}.x ELSE '' END" if n else f'{p}.x'}, 'k': {p}.k + {n}}}"

    after = ", ".join(_best([added(s, n) for n in range(3)]) for s in range(4))
    zero = lambda c, a, x, k: f"{{'c': {c}::BIGINT, 'a': '{a}', 'x': {x}, 'k': {k}::BIGINT}}"
    ends = ", ".join([zero(0, "", "''", 0), zero(10, "II", "'user:' || chr(10) || 'assistant:'", 2), zero(5, "I", "'assistant:'", 1), zero(0, "", "''", 0)])
    gap = "[\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_replace(text, '{gap}+', '', 'g') AS solid FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM e)),
r AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
walk(conv_id, i, v) AS (SELECT conv_id, n, [{ends}] FROM n
 UNION ALL SELECT conv_id, i, [{after}] FROM (SELECT w.conv_id, w.i - 1 AS i, (SELECT [{', '.join(plain)}] FROM (SELECT w.v AS v, q.role AS role, q.text AS text, q.fault IN ('blank', 'duplicate') AS doomed, (q.fault = 'truncated')::INT AS cut)) AS p FROM walk w JOIN r q ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.i = w.i)),
best AS (SELECT conv_id, v[1] AS b FROM walk WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.x, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id"""


SQL = {"op8_warc_archives": WARC, "op11_pivotal_spelling": SPELLING, "op13_conversation_repair": _conversations()}
