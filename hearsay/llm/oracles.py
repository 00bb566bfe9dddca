"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import merkle, rules

# crc32 of an ASCII string, by the reflected polynomial 0xEDB88320: `crc_table` and an expression over it.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k, 1))::BIGINT)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


WORD = r"[^\x20\x09-\x0D]"


def rules_sql() -> str:
    fails = " + ".join(f"CASE WHEN {rule} THEN {1 << bit} ELSE 0 END" for bit, (_, rule) in enumerate(rules.RULES))
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT r, regexp_extract_all(text, '{WORD}+') AS w FROM texts),
windows AS (
  SELECT r, i, w[i:i + {rules.WINDOW - 1}] AS five FROM (SELECT r, w, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i FROM worded)),
often AS (SELECT r, five FROM windows GROUP BY r, five HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {rules.WINDOW})) AS p FROM windows SEMI JOIN often USING (r, five))
  GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts),
lined AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims,
    len(list_filter(w, lambda x: regexp_matches(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]')))::BIGINT AS n_letter_words
  FROM texts JOIN worded USING (r) LEFT JOIN covered USING (r) LEFT JOIN lined USING (r)),
judged AS (SELECT *, ({fails})::INTEGER AS fails FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fails & {rules.mask_of(rules.POLICIES[rules.BASE])}) <> 0 AS base_failed,
  (fails & {rules.mask_of({*rules.POLICIES[rules.CURRENT], *rules.POLICIES[rules.BASE]})}) = 0 AS kept, fails
FROM judged"""


def _tree(name: str, leaves: str, group: str, levels: int) -> str:
    """CTEs `{name}0` .. `{name}{levels}` (group, p, h) and `{name}proof` (group, place, before and after by level)."""
    f = merkle.FANOUT
    parts = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        parts.append(f"""{name}n{k} AS (SELECT {group}, count(*) AS n FROM {name}{k} GROUP BY {group})""")
        parts.append(f"""{name}{k + 1} AS (
  SELECT {group}, CASE WHEN n = 1 THEN p ELSE p // {f} END AS p,
    CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY q)) END AS h
  FROM (SELECT {group}, p AS q, p, h, n FROM {name}{k} JOIN {name}n{k} USING ({group}))
  GROUP BY {group}, CASE WHEN n = 1 THEN p ELSE p // {f} END)""")
    for k in range(levels):
        at = f"(a.p // {f ** k})"
        same = f"b.{group} = a.{group} AND b.p // {f} = {at} // {f}"
        parts.append(f"""{name}beside{k} AS (
  SELECT a.{group}, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < {at}), '') AS before{k},
    coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > {at}), '') AS after{k}, any_value(n) > 1 AS there{k}
  FROM {name}0 a JOIN {name}n{k} USING ({group}) LEFT JOIN {name}{k} b ON {same} GROUP BY a.{group}, a.p)""")
    return ",\n".join(parts)


def merkle_sql(levels: int = 4, upper: int = 3) -> str:
    """Trees of up to FANOUT ** levels leaves a source and FANOUT ** upper sources."""
    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    plain = " || ".join(field(c) for c in merkle.FIELDS)
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    other = " || ".join(field(low if c == "text" else c) for c in merkle.FIELDS)
    joins = " ".join(f"JOIN lbeside{k} USING (g, p)" for k in range(levels))
    joins += " JOIN (SELECT g, p AS s FROM tops) USING (g) "
    joins += " ".join(f"JOIN (SELECT p AS s, before{k} AS ubefore{k}, after{k} AS uafter{k}, there{k} AS uthere{k} FROM sbeside{k}) USING (s)" for k in range(upper))
    steps = [(f"before{k}", f"after{k}", f"there{k}") for k in range(levels)]
    steps += [(f"ubefore{k}", f"uafter{k}", f"uthere{k}") for k in range(upper)]
    proof = " || ".join(f"CASE WHEN {t} THEN {b} || {a} ELSE '' END" for b, a, t in steps)
    folds, last = [], "start"
    for i, (b, a, t) in enumerate(steps):
        folds.append(f"fold{i} AS (SELECT * EXCLUDE ({last}), CASE WHEN {t} THEN sha256({b} || {last} || {a}) ELSE {last} END AS f{i} "
                     f"FROM {'whole' if i == 0 else f'fold{i - 1}'})")
        last = f"f{i}"
    return f"""
WITH {CRC_TABLE},
leaves AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS g, sha256({plain}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc32("doc_id::VARCHAR")} % 5 = 0 THEN sha256({other}) END AS other
  FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS p FROM leaves),
{_tree("l", "SELECT g, p, leaf AS h FROM placed", "g", levels)},
tops AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS p FROM l{levels}),
{_tree("s", "SELECT 1 AS one, p, subroot AS h FROM tops", "one", upper)},
whole AS (
  SELECT placed.*, subroot, (SELECT h FROM s{upper}) AS root, coalesce(other, leaf) AS start, * EXCLUDE (doc_id, source, g, leaf, other, p, subroot)
  FROM placed JOIN (SELECT g, subroot FROM tops) USING (g) {joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {last} AS folded_root, {last} = root AS verified
FROM fold{len(steps) - 1}"""


def conversations_sql() -> str:
    """Each conversation is folded row by row; a state is its cheapest way {cost, audit, text}, null where there is none."""
    def way(state: str, cost: str, letter: str, said: str) -> str:
        text = f"{state}.t" if said == "NULL" else f"CASE WHEN {state}.t IS NULL THEN '' ELSE {state}.t || chr(10) END || {said}"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"

    def when(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} END"

    said = "role || ':' || text"
    extra = "(CASE WHEN truncated THEN 5 ELSE 0 END)"

    def keep(state: str, initial: str) -> str:
        return when(f"NOT gone AND initial = '{initial}'", way(state, extra, "K", said))

    def rerole(state: str, role: str) -> str:
        return when(f"NOT gone AND role <> '{role}'", way(state, f"1 + {extra}", "R", f"'{role}:' || text"))

    moved = {
        "m0": way("w0", "2", "D", "NULL"),
        "m1": least(way("w1", "2", "D", "NULL"), keep("w0", "s")),
        "m2": least(way("w2", "2", "D", "NULL"), *[keep(s, "u") for s in ("w0", "w1", "w3")], *[rerole(s, "user") for s in ("w0", "w1", "w3")]),
        "m3": least(way("w3", "2", "D", "NULL"), keep("w2", "a"), rerole("w2", "assistant")),
    }
    # Inserted turns: first what follows without a turn between, then what follows that.
    insert_user = [way(s, "5", "I", "'user:'") for s in ("m0", "m1", "m3")]
    first = {"v2": least("m2", *insert_user), "v3": least("m3", way("m2", "5", "I", "'assistant:'"))}
    second = {"w2": least("v2", way("v3", "5", "I", "'user:'")), "w3": least("v3", way("v2", "5", "I", "'assistant:'"))}
    columns = ", ".join(f"{v} AS {k}" for k, v in moved.items())
    inserts = ", ".join(f"{v} AS {k}" for k, v in first.items())
    after = ", ".join(f"{v} AS {k}" for k, v in second.items())
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    begin = "{'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}"

    def closed(source: str, keys: str) -> str:
        return f"SELECT {keys}, m0 AS w0, m1 AS w1, {after} FROM (SELECT *, {inserts} FROM ({source}))"

    return f"""
WITH RECURSIVE {CRC_TABLE},
cased AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM cased, range(2) AS copies(k) WHERE h <> 0 AND (k = 0 OR h = 3)),
placed AS (
  SELECT *, coalesce('=' || conv_id::VARCHAR, '') AS g, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    NOT regexp_matches(text, '{WORD}') AS blank
  FROM damaged),
met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeated FROM placed),
judged AS (
  SELECT *, NOT blank AND repeated AS duplicate, blank OR repeated AS gone,
    NOT blank AND NOT repeated AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM met),
counted AS (
  SELECT conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id, g),
walk AS (
  {closed(f"SELECT g, 0::BIGINT AS i, {begin} AS m0, {none} AS m1, {none} AS m2, {none} AS m3 FROM counted", "g, i")}
  UNION ALL
  {closed(f"SELECT j.g, j.i, {columns} FROM walk JOIN judged j ON j.g = walk.g AND j.i = walk.i + 1", "g, i")}),
ended AS (SELECT g, {least("w0", "w3")} AS best FROM walk JOIN counted USING (g) WHERE i = n)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id::VARCHAR, '') AS g FROM conversations) o
LEFT JOIN counted c USING (g) LEFT JOIN ended USING (g)"""
