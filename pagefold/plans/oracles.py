"""The queries of ``queries`` in SQL, for another engine."""

from __future__ import annotations

from ..functions.codec import METHODS

_ITEMS = """
p AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS nr, count(*) OVER () AS n,
    rpad(CASE WHEN l_linenumber <= 2 THEN l_returnflag || l_linestatus
      WHEN l_linenumber <= 5 THEN l_returnflag || l_linestatus || '-' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 4, '0')
      ELSE l_returnflag || l_linestatus || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_orderkey AS VARCHAR), 14, '0') END, 32, '.') AS content
  FROM lineitem
), every AS (
  SELECT nr AS page_nr, content FROM p
), ref AS (
  SELECT nr AS page_nr, content FROM p WHERE nr < n // 2
), src AS (
  SELECT nr - n // 2 AS page_nr, content FROM p WHERE nr >= n // 2
)"""

_BASE = (
    _ITEMS
    + """, dict AS (
  SELECT content, min(page_nr) AS first_nr FROM ref GROUP BY content
), base AS (
  SELECT s.page_nr, s.content, r.content AS rc, first_nr,
    CASE WHEN s.content = r.content THEN 'SAME' WHEN first_nr IS NOT NULL THEN 'DEDUP' ELSE 'NEW' END AS c0
  FROM src s LEFT JOIN ref r USING (page_nr) LEFT JOIN dict ON dict.content = s.content
)"""
)

_DIFF = (
    _BASE
    + """, d AS (
  SELECT page_nr, i FROM (SELECT page_nr, content, rc, unnest(range(1, 33)) AS i FROM base WHERE c0 = 'NEW' AND rc IS NOT NULL) WHERE substr(content, i, 1) <> substr(rc, i, 1)
), f AS (
  SELECT page_nr, i, CASE WHEN i - lag(i) OVER (PARTITION BY page_nr ORDER BY i) <= 3 THEN 0 ELSE 1 END AS b FROM d
), g AS (
  SELECT page_nr, i, sum(b) OVER (PARTITION BY page_nr ORDER BY i) AS k FROM f
), runs AS (
  SELECT page_nr, k, min(i) - 1 AS off, max(i) - min(i) + 1 AS len FROM g GROUP BY page_nr, k
), pt AS (
  SELECT page_nr, CAST(k - 1 AS BIGINT) AS patch_nr, off - coalesce(lag(off + len) OVER (PARTITION BY page_nr ORDER BY off), 0) AS rel_off, len, substr(content, off + 1, len) AS bytes
  FROM runs JOIN src USING (page_nr)
), sz AS (
  SELECT page_nr, CAST(2 + sum(CASE WHEN rel_off < 256 AND len <= 128 THEN 2 ELSE 3 END + len) AS BIGINT) AS size,
    CAST(2 + sum(CASE WHEN rel_off < 128 AND len <= 128 THEN 2 ELSE 3 END + len) AS BIGINT) AS size_128, count(*) AS np
  FROM pt GROUP BY page_nr
), cls AS (
  SELECT base.page_nr, base.content, first_nr, rc, CASE WHEN c0 = 'NEW' AND size < 32 THEN 'DIFF' ELSE c0 END AS cls, CASE WHEN c0 = 'NEW' AND size < 32 THEN np ELSE 0 END AS np, size
  FROM base LEFT JOIN sz USING (page_nr)
)"""
)

_TEXT = """
t AS (
  SELECT doc_id AS dump_id, unnest(range(0, (length(text) - 1) // 64 + 1)) AS page_nr, text FROM documents WHERE length(text) > 0
), pages AS (
  SELECT dump_id, page_nr, substr(text, 64 * page_nr + 1, 64) AS content FROM t
)"""

_LINES = """
t AS (
  SELECT doc_id AS dump_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), pages AS (
  SELECT dump_id, unnest(range(0, len(ls))) AS page_nr, unnest(ls) AS content FROM t
)"""

_PAIRS = """, pr AS (
  SELECT dump_id, ref_id FROM (SELECT dump_id, min(dump_id) OVER (PARTITION BY content) AS ref_id FROM pages WHERE page_nr = 0) WHERE dump_id <> ref_id
)"""

_MANY = (
    _PAIRS
    + """, s AS (
  SELECT * FROM pages LEFT JOIN pr USING (dump_id)
), dict AS (
  SELECT dump_id, content, min(page_nr) AS first_nr FROM pages GROUP BY dump_id, content
), many AS (
  SELECT s.dump_id, s.page_nr, CASE WHEN s.content = r.content THEN 'SAME' WHEN first_nr IS NOT NULL THEN 'DEDUP' ELSE 'NEW' END AS cls, first_nr
  FROM s LEFT JOIN pages r ON r.dump_id = s.ref_id AND r.page_nr = s.page_nr LEFT JOIN dict ON dict.dump_id = s.ref_id AND dict.content = s.content
)"""
)


def _runs(of: str, key: str, name: str = "iv", part: str = "") -> str:
    """Gaps and islands of the places of a key."""
    return f""", {name}_k AS (
  SELECT {part}{key}, page_nr, page_nr - row_number() OVER (PARTITION BY {part}{key} ORDER BY page_nr) AS island FROM {of}
), {name} AS (
  SELECT {part}{key}, min(page_nr) AS "left", max(page_nr) AS "right" FROM {name}_k GROUP BY {part}{key}, island
)"""


def _le(x: str, n: int) -> str:
    return " || ".join(f"printf('%02X', CAST((({x}) >> {8 * k}) & 255 AS INTEGER))" for k in range(n))


def _be(x: str, n: int) -> str:
    return " || ".join(f"printf('%02X', CAST((({x}) >> {8 * k}) & 255 AS INTEGER))" for k in range(n - 1, -1, -1))


_DEDUP = ", dd AS (SELECT first_nr, page_nr FROM base WHERE c0 = 'DEDUP')" + _runs("dd", "first_nr")
_DEDUP_D = ", dd AS (SELECT first_nr, page_nr FROM cls WHERE cls = 'DEDUP')" + _runs("dd", "first_nr")
_NEW_D = ", nn AS (SELECT content, page_nr FROM cls WHERE cls = 'NEW')" + _runs("nn", "content", "nv")
_HEADER = f"CASE WHEN len <= 128 AND rel_off < 256 THEN {_be('len - 1', 1)} || {_be('rel_off', 1)} ELSE {_be('8388608 + (len - 1) * 4096 + rel_off', 3)} END"
_WIDTH = """CASE WHEN "right" - "left" = 0 THEN 4 WHEN "right" - "left" < 256 THEN 5 WHEN "right" - "left" < 65536 THEN 6 ELSE 8 END"""
_CODE = f"""CASE WHEN "right" = "left" THEN '' WHEN "right" - "left" < 256 THEN {_le('"right" - "left"', 1)} WHEN "right" - "left" < 65536 THEN {_le('"right" - "left"', 2)} ELSE {_le('"right" - "left"', 4)} END"""
_WORD = """(CASE WHEN last THEN 2147483648 ELSE 0 END + CASE WHEN "right" = "left" THEN 0 WHEN "right" - "left" < 256 THEN 1 WHEN "right" - "left" < 65536 THEN 2 ELSE 3 END * 536870912 + "left")"""
_GAPS = """, nw AS (
  SELECT dump_id, page_nr, row_number() OVER (PARTITION BY dump_id ORDER BY page_nr) AS ord,
    coalesce(page_nr - lag(page_nr) OVER (PARTITION BY dump_id ORDER BY page_nr) - 1, page_nr) AS gap
  FROM many WHERE cls = 'NEW'
)"""
_HEADERS = f"hd AS (SELECT unnest([{', '.join(repr(m) for m in METHODS)}]) AS method, CAST(4096 AS BIGINT) AS pagesize, CAST(n_nationkey AS BIGINT) * 123456789 AS size FROM nation)"
_BYTES = (
    "WITH "
    + _TEXT
    + _PAIRS
    + """, h AS (
  SELECT doc_id AS dump_id, hex(encode(text)) AS x FROM documents
), hp AS (
  SELECT dump_id, unnest(range(0, (length(x) - 1) // 128 + 1)) AS page_nr, x FROM h WHERE length(x) > 0
)
SELECT dump_id, page_nr, substr(x, 128 * page_nr + 1, 128) AS content_hex FROM hp"""
)
_SHA = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"


def _stat(name: str, where: str) -> str:
    return f"count(*) FILTER ({where}) AS {name}_total, count(DISTINCT content) FILTER ({where}) AS {name}_distinct"


ORACLES = {
    "classify_delta": f"WITH {_DIFF} SELECT cls, count(*) AS total, count(DISTINCT content) AS distinct_contents, CAST(sum(np) AS BIGINT) AS patches FROM cls GROUP BY cls",
    "page_scan": f"WITH {_TEXT} SELECT * FROM pages",
    "page_scan_full": f"WITH {_TEXT} SELECT * FROM pages WHERE length(content) = 64",
    "dump_size": f"WITH {_TEXT} SELECT dump_id, CAST(sum(length(content)) AS BIGINT) AS size, count(*) AS pages FROM pages GROUP BY dump_id",
    "page_enumerate": f"WITH {_ITEMS} SELECT nr AS page_nr, content FROM p",
    "distinct_pages": f"WITH {_ITEMS} SELECT DISTINCT content FROM every",
    "content_index": f"WITH {_ITEMS} SELECT content, count(*) AS n, min(page_nr) AS first_nr, max(page_nr) AS last_nr FROM every GROUP BY content",
    "first_occurrence": f"WITH {_ITEMS} SELECT content, min(page_nr) AS first_nr FROM every GROUP BY content",
    "inverse_map": f"WITH {_ITEMS} SELECT page_nr, content FROM every",
    "same_offset": f"WITH {_BASE} SELECT page_nr, coalesce(content = rc, FALSE) AS same FROM base",
    "dedup_membership": f"WITH {_BASE} SELECT page_nr, coalesce(first_nr, -1) AS first_nr, first_nr IS NOT NULL AS in_ref FROM base",
    "pages_in_ref": f"WITH {_ITEMS} SELECT page_nr FROM src WHERE content IN (SELECT content FROM ref)",
    "pages_not_in_ref": f"WITH {_ITEMS} SELECT page_nr, content FROM src WHERE content NOT IN (SELECT content FROM ref)",
    "dedup_positions": f"WITH {_BASE} SELECT first_nr, page_nr FROM base WHERE c0 = 'DEDUP'",
    "classify": f"WITH {_TEXT} {_MANY} SELECT dump_id, page_nr, cls, coalesce(first_nr, -1) AS first_nr FROM many",
    "classify_lines": f"WITH {_LINES} {_MANY} SELECT dump_id, page_nr, cls, coalesce(first_nr, -1) AS first_nr FROM many",
    "byte_diff": f"WITH {_DIFF} SELECT page_nr, patch_nr, rel_off, len, bytes FROM pt",
    "patch_split": "SELECT p_partkey, piece, CAST(least(2048, p_size * 200 - piece * 2048) AS BIGINT) AS len FROM (SELECT p_partkey, p_size, unnest(range(0, (p_size * 200 - 1) // 2048 + 1)) AS piece FROM part)",
    "diff_size": f"WITH {_DIFF} SELECT page_nr, size AS size_256, size_128 FROM sz",
    "diff_accept": f"WITH {_DIFF} SELECT page_nr FROM sz WHERE size < 32",
    "diff_list": f"WITH {_DIFF} SELECT page_nr, np AS n_patches, size FROM cls WHERE cls = 'DIFF'",
    "intervalize": f"WITH {_ITEMS} {_runs('every', 'content')} SELECT * FROM iv",
    "interval_expand": f"WITH {_BASE} SELECT first_nr, page_nr FROM base WHERE c0 = 'DEDUP'",
    "interval_total": f"WITH {_BASE} SELECT first_nr, count(*) AS total FROM base WHERE c0 = 'DEDUP' GROUP BY first_nr",
    "dedup_groups": f'WITH {_DIFF} {_DEDUP_D} SELECT first_nr, CAST(sum("right" - "left" + 1) AS BIGINT) AS n, count(*) AS n_intervals, min("left") AS first_place, max("right") AS last_place FROM iv GROUP BY first_nr',
    "new_groups": f"WITH {_DIFF} SELECT content, min(page_nr) AS first_place, count(*) AS n FROM cls WHERE cls = 'NEW' GROUP BY content",
    "inter_stats": f"WITH {_DIFF} SELECT " + ", ".join(_stat(n, w) for n, w in (("same", "cls = 'SAME'"), ("moved", "cls = 'DEDUP'"), ("dedup", "cls IN ('SAME', 'DEDUP')"), ("diff", "cls = 'DIFF'"), ("new", "cls = 'NEW'"), ("all", "TRUE"))) + " FROM cls",
    "decode_stats": f"WITH {_DIFF} SELECT " + ", ".join(_stat(n, w) for n, w in (("filled", "cls = 'DEDUP'"), ("same", "cls = 'SAME'"), ("new", "cls = 'NEW'"), ("seen", "cls <> 'DIFF'"))) + ", count(*) FILTER (cls = 'DIFF') AS diff_total FROM cls",
    "intra_stats": f"WITH {_ITEMS}, c AS (SELECT content, count(*) AS n FROM every GROUP BY content) SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS deduped, CAST(sum(n) AS BIGINT) AS pages, count(*) FILTER (n > 1) AS groups, count(*) AS distinct_pages FROM c",
    "progress": f"WITH {_TEXT} SELECT dump_id, page_nr, 100 * sum(length(content)) OVER (PARTITION BY dump_id ORDER BY page_nr ROWS UNBOUNDED PRECEDING) / sum(length(content)) OVER (PARTITION BY dump_id) AS percent FROM pages",
    "diff_apply": f"WITH {_DIFF} SELECT page_nr, content FROM cls WHERE cls = 'DIFF'",
    "reconstruct": f"WITH {_ITEMS} SELECT page_nr, content FROM src",
    "intra_dictionary": f"WITH {_ITEMS} SELECT content, min(page_nr) AS first_nr, count(*) AS n FROM every GROUP BY content HAVING count(*) > 1",
    "intra_reconstruct": f"WITH {_TEXT} SELECT dump_id, page_nr, content FROM pages",
    "interval_encode": f"""WITH {_BASE} {_DEDUP}, l AS (SELECT *, lead("left") OVER (PARTITION BY first_nr ORDER BY "left") IS NULL AS last FROM iv) SELECT first_nr, "left", "right", {_le(_WORD, 4)} || {_CODE} AS code FROM l""",
    "pagenr_list": f"WITH {_TEXT} {_MANY} {_GAPS} SELECT dump_id, ord, CASE WHEN gap < 128 THEN {_be('gap + 128', 1)} ELSE {_be('gap', 4)} END AS code FROM nw",
    "pagenr_list_decode": f"WITH {_TEXT} {_MANY} SELECT dump_id, page_nr FROM many WHERE cls = 'NEW'",
    "patch_encode": f"WITH {_DIFF} SELECT page_nr, patch_nr, {_HEADER} AS code FROM pt",
    "diff_encode": f"WITH {_DIFF} SELECT page_nr, {_le('count(*)', 2)} || string_agg({_HEADER} || hex(encode(bytes)), '' ORDER BY patch_nr) AS code FROM pt JOIN sz USING (page_nr) WHERE size < 32 GROUP BY page_nr",
    "diff_decode": f"WITH {_DIFF} SELECT page_nr, patch_nr, rel_off, len, bytes FROM pt JOIN sz USING (page_nr) WHERE size < 32",
    "le_be": f"SELECT n, {_le('n', 4)} AS le4, {_be('n', 4)} AS be4, {_le('n', 8)} AS le8, n AS decoded FROM (SELECT o_orderkey * 7919 AS n FROM orders)",
    "header_encode": f"WITH {_HEADERS} SELECT method, pagesize, size, hex(encode('MBCR')) || '00' || hex(encode(method)) || '0002000100' || {_le('pagesize', 4)} || {_le('size', 8)} AS code FROM hd",
    "header_decode": f"WITH {_HEADERS} SELECT 'MBCR' AS magic, method, CAST(2 AS BIGINT) AS major, CAST(1 AS BIGINT) AS minor, pagesize, size FROM hd",
    "method_parse": f"WITH m AS (SELECT unnest([{', '.join(repr(m) for m in METHODS)}]) AS method) SELECT method, coalesce(nullif(regexp_extract(method, '^(inter|intra)dedup'), ''), 'whole') AS kind, starts_with(method, 'interdedup') AND NOT contains(method, 'nointra') AS intra, contains(method, 'delta') AS delta, regexp_extract(method, '(gzip|bzip2|7zip)$') AS inner_codec FROM m",
    "binlen": "SELECT o_orderkey, length(format('{:b}', o_orderkey)) AS bits FROM orders",
    "msg_padding": "SELECT o_orderkey, 8 - o_orderkey % 8 AS padding, o_orderkey % 256 AS message_id FROM orders",
    "archive_sections": f"""WITH {_DIFF} {_DEDUP_D} {_NEW_D}
SELECT 'dedup intervals' AS section, count(*) AS entries, CAST(coalesce(sum({_WIDTH}), 0) AS BIGINT) AS bytes FROM iv
UNION ALL SELECT 'diffs', count(*), CAST(coalesce(sum(size), 0) AS BIGINT) FROM cls WHERE cls = 'DIFF'
UNION ALL SELECT 'new intervals', count(*), CAST(coalesce(sum({_WIDTH}), 0) AS BIGINT) FROM nv
UNION ALL SELECT 'new pages', count(DISTINCT content), CAST(32 * count(DISTINCT content) AS BIGINT) FROM nv""",
    "archive_parse": _BYTES,
    "intra_parse": _BYTES,
    "inner_codec": _BYTES,
    "intra_sections": f"WITH {_TEXT}, c AS (SELECT dump_id, content, count(*) AS n FROM pages GROUP BY dump_id, content) SELECT dump_id, count(*) FILTER (n > 1) AS groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS filled, count(*) FILTER (n = 1) AS literals FROM c GROUP BY dump_id",
    "signature_scan": f"WITH {_ITEMS} SELECT page_nr FROM every WHERE contains(content, 'O-001')",
    "dump_write": f"WITH {_ITEMS} SELECT nr // 16 AS page_nr, string_agg(content, '' ORDER BY nr) AS content FROM p GROUP BY nr // 16",
    "registry": "SELECT 'nation.parquet' AS reference, CAST(512 AS BIGINT) AS pagesize",
    "codec_gzip": _SHA,
    "codec_bzip2": _SHA,
    "codec_xz": _SHA,
}
