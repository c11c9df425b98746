"""The SQL that the queries on reads are held against: plain SQL over the same tables, which DuckDB runs."""

from __future__ import annotations

from .functions.headers import BCL2FASTQ_LANES, BCL2FASTQ_NO_LANES, BCL_PROCESSOR, UNKNOWN_HEADER  # noqa: F401
from .operators.adapters import ENDS, LOCATIONS
from .operators.sample_index import SETS
from .virtual import BASES, BASES_N, HEX

_RE = {k: v.replace(r"\z", "$") for k, v in (("lanes", BCL2FASTQ_LANES), ("plain", BCL2FASTQ_NO_LANES), ("processor", BCL_PROCESSOR))}


def _seq(key: str, letters: str = BASES_N) -> str:
    return f"translate(md5(CAST({key} AS VARCHAR)), '{HEX}', '{letters}')"


def _qual(key: str) -> str:
    return f"translate(md5('q' || CAST({key} AS VARCHAR)), '{HEX}', '!#%'')+-/13579;?I')"


_READS = f"SELECT event_id AS id, substr({_seq('user_id')}, 1, 16) || {_seq('event_id')} AS seq, {_qual('event_id')} || {_qual('user_id')} AS qual FROM events"
_SHORT = f"SELECT o_orderkey AS id, substr({_seq('o_orderkey')}, 1, o_orderkey % 9) AS s FROM orders"
_RANGES = """SELECT k AS id, k % 40 AS o1, CASE WHEN k % 3 <> 0 THEN k % 23 END AS n1, k % 31 AS o2, CASE WHEN k % 4 <> 0 THEN k % 17 END AS n2
    FROM (SELECT l_orderkey * 7 + l_linenumber AS k FROM lineitem)"""
_HEADER = """CASE WHEN event_id % 7 = 0 THEN printf('read-%d/1', event_id)
    ELSE printf('INST%d:%d:FC%d:%d:1101:%d:1000 1:N:0', event_id % 3, event_id % 50, event_id % 5, event_id % 8 + 1, event_id) END"""
_PATHS = f"""SELECT i AS id, '/run/' || (i % 5) || '/' || CASE
        WHEN i % 3 = 0 THEN printf('read-%s_si-%s_lane-%03d-chunk-%03d.fastq.lz4', ['RA', 'I1', 'I2'][i % 3 + 1], substr({_seq('(i % 40)')}, 1, 8), i % 4 + 1, i % 2)
        WHEN i % 11 = 0 THEN 'notes.txt'
        ELSE printf('sample_%d_S%d%s_%s_001.fastq%s', i % 13, i % 13 + 1, CASE WHEN i % 13 < 9 THEN printf('_L%03d', i % 4 + 1) ELSE '' END,
                    ['R1', 'R2', 'I1', 'I2', 'R3', 'R1', 'R2'][i % 7 + 1], CASE WHEN i % 2 = 0 THEN '.gz' ELSE '' END) END AS path
    FROM (SELECT o_orderkey AS i FROM orders)"""
_NAMES = f"""SELECT id, path, regexp_extract(name, '{_RE['lanes']}', 1) AS a1, regexp_matches(name, '{_RE['lanes']}') AS lanes, regexp_matches(name, '{_RE['plain']}') AS plain, name
    FROM (SELECT id, path, split_part(path, '/', -1) AS name FROM paths)"""
_BCL2FASTQ = f"""SELECT id, path, CASE WHEN lanes THEN regexp_extract(name, '{_RE['lanes']}', 1) ELSE regexp_extract(name, '{_RE['plain']}', 1) END AS sample,
        CAST(CASE WHEN lanes THEN regexp_extract(name, '{_RE['lanes']}', 2) ELSE regexp_extract(name, '{_RE['plain']}', 2) END AS BIGINT) AS s,
        CAST(CASE WHEN lanes THEN regexp_extract(name, '{_RE['lanes']}', 3) END AS BIGINT) AS lane,
        CASE WHEN lanes THEN regexp_extract(name, '{_RE['lanes']}', 4) ELSE regexp_extract(name, '{_RE['plain']}', 3) END AS read,
        CAST(CASE WHEN lanes THEN regexp_extract(name, '{_RE['lanes']}', 5) ELSE regexp_extract(name, '{_RE['plain']}', 4) END AS BIGINT) AS chunk
    FROM names WHERE lanes OR plain"""
_PROCESSOR = f"""SELECT id, path, regexp_extract(name, '{_RE['processor']}', 2) AS si, CAST(regexp_extract(name, '{_RE['processor']}', 3) AS BIGINT) AS lane,
        regexp_extract(name, '{_RE['processor']}', 1) AS read, CAST(regexp_extract(name, '{_RE['processor']}', 4) AS BIGINT) AS chunk
    FROM names WHERE regexp_matches(name, '{_RE['processor']}')"""
_FILES = f"WITH paths AS ({_PATHS}), names AS ({_NAMES})"
_SETS1 = f"""{_FILES}, f AS ({_BCL2FASTQ}), p AS (SELECT sample, s, lane, chunk, {', '.join(f"max(path) FILTER (read = '{r}') AS {r.lower()}" for r in ('R1', 'R2', 'R3', 'I1', 'I2'))} FROM f GROUP BY ALL),
    sets AS (SELECT sample, s, lane, chunk, r1, CASE WHEN r3 IS NULL THEN r2 ELSE r3 END AS r2, CASE WHEN r3 IS NULL THEN i1 ELSE r2 END AS i1, CASE WHEN r3 IS NULL THEN i2 ELSE i1 END AS i2, false AS r1_interleaved FROM p WHERE r1 IS NOT NULL)"""
_SETS2 = f"""{_FILES}, f AS ({_PROCESSOR}), sets AS (SELECT si, lane, chunk, min(path) FILTER (read = 'RA') AS r1, CAST(NULL AS VARCHAR) AS r2, min(path) FILTER (read = 'I1') AS i1,
    min(path) FILTER (read = 'I2') AS i2, true AS r1_interleaved FROM f GROUP BY ALL HAVING r1 IS NOT NULL)"""
_STREAM = "WITH e AS (SELECT event_id AS id, event_id % 20 AS group_id, event_id // 20 AS ordinal FROM events)"
_INDEXED = "NOT (group_id = 3 AND ordinal >= 10)"
_PREFIX2 = "CASE WHEN id % 97 = 5 THEN 'x' ELSE '' END || 'c:' || id"


def _hamming(skip: str, mutation: str) -> str:
    return f"""WITH b AS ({_SHORT}), p AS (SELECT id, s, unnest(generate_series(1, length(s))) AS i FROM b), c AS (SELECT id, s, i, unnest({list(mutation)}) AS c FROM p)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, c) - 1 AS k, substr(s, 1, i - 1) || c || substr(s, i + 1) AS neighbor FROM c WHERE substr(s, i, 1) <> c AND NOT contains('{skip}', substr(s, i, 1))"""


def _poly(end: str, location: str, m: int = 8) -> str:
    if end == "three_prime":
        low = "0" if location == "anywhere" else f"greatest(n - {m}, 0)"
        high = f"greatest(n - {m}, 0) + 1" if location == "anchored" else "n"
        start, stop = "p", f"least(n, p + {m})"
        ranges = "a AS adapter_start, z AS adapter_end, a AS trim_start, n AS trim_end, CAST(0 AS BIGINT) AS retain_start, a AS retain_end"
    else:
        low = str(m) if location == "anchored" else "0"
        high = "n" if location == "anywhere" else f"least({m}, n) + 1"
        start, stop = f"greatest(p - {m}, 0)", "p"
        ranges = "a AS adapter_start, z AS adapter_end, CAST(0 AS BIGINT) AS trim_start, z AS trim_end, z AS retain_start, n AS retain_end"
    made = f"translate(md5(CAST(event_id AS VARCHAR)), '{HEX}', 'AAAAAAAAAAAACGTN')"
    return f"""WITH r AS (SELECT event_id AS id, substr({made}, 1, event_id % 33) AS s FROM events), n AS (SELECT *, length(s) AS n FROM r),
        p AS (SELECT *, unnest(range({low}, {high})) AS p FROM n), w AS (SELECT *, {start} AS a, {stop} AS z FROM p),
        c AS (SELECT *, z - a AS size, length(regexp_replace(substr(s, a + 1, z - a), '[^A]', '', 'g')) AS matches FROM w),
        best AS (SELECT * FROM c WHERE size >= 5 AND (size - matches) * 10 <= size QUALIFY row_number() OVER (PARTITION BY id ORDER BY matches DESC, size - matches, p) = 1)
        SELECT id, {ranges}, matches - 2 * (size - matches) AS score FROM best"""


SQL: dict[str, str] = {
    "barcode_umi_counts": f"""WITH r AS ({_READS}), b AS (SELECT substr(seq, 1, 16) AS barcode, substr(seq, 17, 10) AS umi FROM r)
        SELECT barcode, count(*) AS n_reads, count(DISTINCT umi) AS n_umis FROM b
        WHERE NOT contains(barcode, 'N') AND NOT contains(umi, 'N') AND barcode <> repeat(barcode[1], 16) AND umi <> repeat(umi[1], 10) GROUP BY barcode""",
    "range_slices": f"""WITH b AS ({_SHORT}) SELECT id, CASE WHEN 5 <= length(s) THEN substr(s, 3, 3) END AS closed, CASE WHEN 3 <= length(s) THEN substr(s, 4) END AS open,
        CASE WHEN id % 11 + id % 5 <= length(s) THEN substr(s, id % 11 + 1, id % 5) END AS varied FROM b""",
    "range_intersect": f"""WITH r AS ({_RANGES}), e AS (SELECT *, least(o1 + n1, o2 + n2) AS e FROM r)
        SELECT id, o1, n1, o2, n2, least(e, greatest(o1, o2)) AS "offset", e - least(e, greatest(o1, o2)) AS len FROM e""",
    "range_shrink": f"""SELECT id, o1, n1, o1 + id % 2 AS "offset", id % 4 // 2 AS len FROM ({_RANGES}) WHERE n1 >= 2 OR n1 IS NULL""",
    "range_trim": f"""SELECT id, o1 + id % 4 AS offset5, n1 - id % 4 AS len5, o1 AS offset3, n1 - id % 3 AS len3 FROM ({_RANGES}) WHERE n1 >= 3 OR n1 IS NULL""",
    "range_packed": f"""SELECT id, o1 * 32768 + coalesce(n1, 32767) AS packed, o1 AS "offset", n1 AS len FROM ({_RANGES})""",
    "seq_validate": f"""WITH b AS ({_SHORT}), t AS (SELECT id, CASE WHEN id % 5 = 0 THEN s || 'x' WHEN id % 7 = 0 THEN lower(s) ELSE s END AS s FROM b)
        SELECT id, regexp_full_match(s, '[ACGTN]*') AS valid, CASE WHEN NOT regexp_full_match(s, '[ACGTN]*') THEN length(regexp_extract(s, '^[ACGTN]*')) END AS bad_at FROM t""",
    "qual_validate": f"SELECT event_id AS id, regexp_full_match(CASE WHEN event_id % 6 = 0 THEN {_qual('event_id')} || ' ' ELSE {_qual('event_id')} END, '[!-~]*') AS valid FROM events",
    "seq_predicates": f"""SELECT id, contains(s, 'N') AS has_n, CASE WHEN s <> '' THEN s = repeat(s[1], length(s)) END AS homopolymer, suffix(s, 'TT') AS polyt2, suffix(s, 'A') AS ends_a FROM ({_SHORT})""",
    "encode_2bit": f"""WITH b AS (SELECT event_id AS id, substr({_seq('event_id', BASES)}, 1, event_id % 17) AS s FROM events)
        SELECT id, s, CAST(coalesce(list_sum(list_transform(range(1, length(s) + 1), lambda i: (strpos('ACGT', substr(s, i, 1)) - 1) * CAST(pow(4, length(s) - i) AS BIGINT))), 0) AS BIGINT) AS code FROM b""",
    "hamming_skip": _hamming("N", "ACGT"),
    "hamming_mutate": _hamming("", "ACGT"),
    "hamming_custom": _hamming("AN", "CGN"),
    "deletion_neighbors": f"""WITH b AS ({_SHORT}), p AS (SELECT id, s, unnest(generate_series(1, length(s))) AS i FROM b) SELECT id, i - 1 AS k, substr(s, 1, i - 1) || substr(s, i + 1) AS neighbor FROM p""",
    "insertion_neighbors": f"""WITH b AS ({_SHORT}), p AS (SELECT id, s, unnest(generate_series(0, length(s))) AS i FROM b), c AS (SELECT id, s, i, unnest(generate_series(1, 4)) AS j FROM p)
        SELECT id, i * 4 + j - 1 AS k, substr(s, 1, i) || substr('ACGT', j, 1) || substr(s, i + 1) AS neighbor FROM c""",
    "edit_neighbors": f"""WITH b AS ({_SHORT}), p AS (SELECT id, s, unnest(generate_series(0, length(s))) AS i FROM b), c AS (SELECT id, s, i, unnest(['A', 'C', 'G', 'T']) AS c FROM p),
        n AS (SELECT id, s, substr(s, 1, i) || c || substr(s, i + 1) AS t FROM c UNION SELECT id, s, substr(s, 1, i - 1) || substr(s, i + 1) FROM p WHERE i > 0
              UNION SELECT id, s, substr(s, 1, i - 1) || c || substr(s, i + 1) FROM c WHERE i > 0 AND substr(s, i, 1) NOT IN (c, 'N'))
        SELECT id, count(*) AS n, min(t) AS first, max(t) AS last  FROM n GROUP BY id""",
    "barcode_correction": f"""WITH l AS (SELECT DISTINCT substr({_seq('s_suppkey', BASES)}, 1, 5) AS barcode FROM supplier), e AS (SELECT event_id AS id, substr({_seq('event_id')}, 1, 5) AS s FROM events)
        SELECT id, count(*) AS n_hits, min(barcode) AS first_hit FROM e JOIN l ON len(list_filter(range(1, 6), lambda i: substr(s, i, 1) <> substr(barcode, i, 1))) <= 1 GROUP BY id""",
    "header_info": f"""WITH h AS (SELECT event_id AS id, string_split(regexp_extract({_HEADER}, '^[^ /]*'), ':') AS p FROM events), g AS (SELECT *, len(p) >= 4 AND regexp_full_match(p[2], '[0-9]+') AND regexp_full_match(p[4], '[0-9]+') AS good FROM h)
        SELECT id, CASE WHEN good THEN p[1] END AS instrument, CASE WHEN good THEN CAST(p[2] AS BIGINT) END AS run_number, CASE WHEN good THEN p[3] END AS flowcell, CASE WHEN good THEN CAST(p[4] AS BIGINT) END AS lane FROM g""",
    "filename_bcl2fastq": f"{_FILES} SELECT * EXCLUDE (path) FROM ({_BCL2FASTQ})",
    "filename_bcl_processor": f"{_FILES} SELECT * EXCLUDE (path) FROM ({_PROCESSOR})",
    "group_files_bcl2fastq": f"{_SETS1} SELECT * FROM sets",
    "group_files_bcl_processor": f"{_SETS2} SELECT * FROM sets",
    "find_by_sample_and_lane": f"{_SETS1} SELECT * FROM sets WHERE sample IN ('sample_1', 'sample_7') AND lane IN (1, 2)",
    "find_by_index": f"""{_SETS2} SELECT * FROM sets WHERE length(si) - length(replace(si, 'N', '')) <= 2 AND len(list_filter(['GAATAATG', 'GATACGTC', 'CTATCATG'],
        lambda t: len(list_filter(range(1, 9), lambda i: substr(si, i, 1) <> 'N' AND substr(si, i, 1) <> substr(t, i, 1))) = 0)) > 0""",
    "index_match_n": f"""WITH b AS (SELECT event_id AS id, substr({_seq('event_id')}, 1, 3) AS observed FROM events),
        m AS (SELECT *, regexp_full_match(observed, '[AN][CN][GN]') AS fits, length(observed) - length(replace(observed, 'N', '')) AS ns FROM b)
        SELECT id, observed, fits AND ns <= 0 AS within_0, fits AND ns <= 1 AS within_1, fits AND ns <= 3 AS within_3 FROM m""",
    "group_samples": f"""WITH sets(si, name) AS (VALUES {', '.join(f"('{s}', '{k}')" for k, v in SETS.items() for s in v)}), named AS (SELECT si, min(name) AS name FROM sets GROUP BY si),
        numbered AS (SELECT si, row_number() OVER (ORDER BY si) - 1 AS k FROM named),
        e AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN substr({_seq('event_id')}, 1, 8) ELSE numbered.si END AS si FROM events JOIN numbered ON event_id % (SELECT count(*) FROM named) = k)
        SELECT coalesce(name, si) AS set_name, count(*) AS n, min(si) AS first_si FROM e LEFT JOIN named USING (si) GROUP BY 1""",
    "zip_reads": f"""{_STREAM} SELECT group_id, ordinal, 'c:' || id || ' 1:N' AS h1, {_seq("'b' || id")} AS seq2, CASE WHEN {_INDEXED} THEN {_seq("'c' || id")} END AS index1, CAST(NULL AS VARCHAR) AS index2 FROM e""",
    "header_mismatch": f"{_STREAM} SELECT group_id, ordinal, 'r2' AS mismatch FROM e WHERE id % 97 = 5",
    "premature_end": f"""{_STREAM}, c AS (SELECT group_id, count(*) AS n, count(*) FILTER ({_INDEXED}) AS m FROM e GROUP BY group_id) SELECT group_id, 'i1' AS ended, m AS records FROM c WHERE m < n""",
    "length_trim": f"""{_STREAM} SELECT group_id, ordinal, substr({_seq("'a' || id")}, 1, 10) AS s1, substr({_qual('id')}, 1, 10) AS q1, {_seq("'b' || id")} AS s2, CASE WHEN {_INDEXED} THEN {_seq("'c' || id")} END AS s3 FROM e""",
    "subsample": f"{_STREAM} SELECT group_id, ordinal FROM e WHERE CAST('0x' || substr(md5('c:' || id || '7'), 1, 8) AS BIGINT) / 4294967296.0 < 0.25",
    "pattern_exists": f"SELECT id, contains(seq, 'GATT') AS found FROM ({_READS})",
    "mean_phred": f"SELECT id, round(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) / CAST(length(qual) AS DOUBLE), 6) AS mean FROM ({_READS})",
    "interleave_roundtrip": f"""{_STREAM} SELECT group_id, ordinal, 'read1' AS which, '@c:' || id || ' 1:N' || chr(10) || {_seq("'a' || id")} || chr(10) || '+' || chr(10) || {_qual('id')} AS text FROM e
        UNION ALL SELECT group_id, ordinal, 'read2', '@' || {_PREFIX2} || '/2' || chr(10) || {_seq("'b' || id")} || chr(10) || '+' || chr(10) || {_qual('id')} FROM e""",
    "trim_adapter": f"""WITH r AS (SELECT event_id AS id, translate(md5(CAST(event_id AS VARCHAR)), '{HEX}', 'CCGTTGGTCCTTGGCC') || CASE event_id % 4 WHEN 0 THEN 'ACGTACGGTTCA' WHEN 1 THEN 'ACGTACGGATCA' WHEN 2 THEN 'ACGTACG' ELSE '' END
        || CASE WHEN event_id % 4 < 2 THEN substr({_seq('event_id')}, 1, event_id % 9) ELSE '' END AS s FROM events)
        SELECT id, CASE WHEN id % 4 < 3 THEN 32 END AS trim_start, CASE WHEN id % 4 < 3 THEN substr(s, 1, 32) ELSE s END AS kept FROM r""",
    "single_ended": f"{_STREAM}, g AS (SELECT group_id, count(*) FILTER (ordinal < 2) AS n FROM e GROUP BY group_id) SELECT group_id, n < 2 OR group_id % 3 = 0 AS single_ended FROM g",
    "odd_interleaved": "SELECT event_id % 17 AS group_id, count(*) AS records FROM events GROUP BY 1 HAVING count(*) % 2 = 1",
    "check_range": f"""{_STREAM} SELECT group_id, ordinal, 'UMI: read1 has 10 bases, but 4 to 12 are needed' AS r1, CAST(NULL AS VARCHAR) AS r2, CASE WHEN NOT ({_INDEXED}) THEN 'Index: there is no index1' ELSE 'Index: index1 has 32 bases, but 30 to 34 are needed' END AS i1,
        'Index: there is no index2' AS i2 FROM e""",
    "empty_pairs": f"{_STREAM} SELECT group_id, ordinal FROM e WHERE ordinal % 6 = 0 AND NOT ({_INDEXED})",
    "read_parts": f"""{_STREAM} SELECT group_id, ordinal, 'c:' || id || ' 1:N' AS h1, {_qual('id')} AS q2, CASE WHEN {_INDEXED} THEN {_seq("'c' || id")} END AS s3, CAST(NULL AS VARCHAR) AS s4, CAST(32 AS BIGINT) AS n_r1, CAST(32 AS BIGINT) AS n_r2,
        CASE WHEN {_INDEXED} THEN CAST(32 AS BIGINT) END AS n_i1, CAST(NULL AS BIGINT) AS n_i2 FROM e""",
    "range_valid": f"SELECT id, o1 * 1000 - 500 BETWEEN 0 AND 32767 AND coalesce(n1 * 1500 - 10 BETWEEN 0 AND 32766, true) AS valid FROM ({_RANGES})",
    "half_open_intersect": f"""SELECT id, least(greatest(o1, o2), least(o1 + n1, o2 + n2)) AS start, least(o1 + n1, o2 + n2) AS "end" FROM ({_RANGES}) WHERE n1 IS NOT NULL AND n2 IS NOT NULL""",
    "pairs_from_long": f"""{_STREAM} SELECT group_id, ordinal, {_seq("'a' || id")} AS s1, {_PREFIX2} || '/2' AS h2, CASE WHEN {_INDEXED} THEN {_qual('id')} END AS q3, CAST(NULL AS VARCHAR) AS s4 FROM e""",
    "read_set_header": f"""WITH f AS (SELECT event_id % 50 AS group_id, min(event_id) AS event_id FROM events GROUP BY 1), h AS (SELECT group_id, string_split(regexp_extract({_HEADER}, '^[^ /]*'), ':') AS p FROM f)
        SELECT group_id, CASE WHEN len(p) >= 4 THEN p[1] ELSE '{UNKNOWN_HEADER[0]}' END AS instrument, CASE WHEN len(p) >= 4 THEN CAST(p[2] AS BIGINT) ELSE 0 END AS run_number,
               CASE WHEN len(p) >= 4 THEN p[3] ELSE '{UNKNOWN_HEADER[2]}' END AS flowcell, CASE WHEN len(p) >= 4 THEN CAST(p[4] AS BIGINT) ELSE 0 END AS lane FROM h""",
    "lane_modes": f"{_SETS1} SELECT coalesce('lane ' || lane, 'all lanes') AS mode, count(*) AS n_groups, count(DISTINCT sample) AS n_samples FROM sets GROUP BY 1",
    "mixed_lanes": f"{_SETS1}, m AS (SELECT s % 5 AS project, count(lane) AS n_split, count(*) - count(lane) AS n_whole FROM sets GROUP BY 1) SELECT *, n_split > 0 AND n_whole > 0 AS mixed FROM m",
    "fastq_defs": f"""{_SETS1} SELECT 0 AS definition, r1, r2, i1, i2, r1_interleaved FROM sets WHERE sample IN ('sample_1', 'sample_7') AND lane IN (1, 2)
        UNION ALL SELECT 1, r1, r2, i1, i2, r1_interleaved FROM ({_SETS2} SELECT * FROM sets) WHERE length(si) - length(replace(si, 'N', '')) <= 2 AND len(list_filter(['GAATAATG', 'GATACGTC', 'CTATCATG'],
        lambda t: len(list_filter(range(1, 9), lambda i: substr(si, i, 1) <> 'N' AND substr(si, i, 1) <> substr(t, i, 1))) = 0)) > 0""",
    "folder_samples": f"{_SETS1} SELECT sample, count(*) AS n_groups, '[' || coalesce(string_agg(DISTINCT lane, ', ' ORDER BY lane), '') || ']' AS lanes FROM sets GROUP BY sample",
    "folder_indices": """SELECT x.index, CAST(x.n AS BIGINT) AS n_groups FROM (SELECT unnest([
        {'index': 'SI-GA-A1', 'n': (SELECT count(*) FROM events WHERE event_id % 4 < 2)}, {'index': 'SI-001', 'n': 0}, {'index': 'SI-P2-H12', 'n': 0}, {'index': 'AAAACCCC', 'n': 0},
        {'index': 'GATTACAA', 'n': (SELECT count(*) FROM events WHERE event_id % 4 = 2)}]) AS x)""",
    "check_samples": f"{_SETS1} SELECT sample, count(*) AS n_groups FROM sets WHERE sample IN ('sample_2', 'sample_8', 'sample_99') AND lane IN (1, 3) GROUP BY sample",
    "char_sets": f"""SELECT id, array_to_string(list_transform(list_sort(list_transform(list_filter(['A', 'C', 'G', 'T', 'N'], lambda c: contains(s, c)), lambda c: strpos(s, c) || c)), lambda x: x[2]), '') AS letters,
        length(s) AS n, nullif(substr(s, 3, 1), '') AS third FROM ({_SHORT})""",
    "construct": f"SELECT id, CASE WHEN NOT (id % 11 = 0 AND contains(s, 'G')) THEN reverse(s) END AS made FROM ({_SHORT})",
    "seq_edits": f"""SELECT id, s || 'A' AS pushed, s[1] || substr(s, 3) AS removed, substr(s, 1, 2) || 'C' || substr(s, 3) AS inserted, s[1] AS first, s[1] || 'G' || substr(s, 3) AS "set" FROM ({_SHORT}) WHERE length(s) >= 3""",
    "seq_order": f"SELECT s, count(*) AS n, lead(s) OVER (PARTITION BY length(s) ORDER BY s) AS next FROM ({_SHORT}) GROUP BY s",
    "quality_scores": f"WITH q AS (SELECT event_id AS id, list_transform(string_split({_qual('event_id')}, ''), lambda c: ascii(c) - 33) AS q FROM events) SELECT id, CAST(list_max(q) AS BIGINT) AS best, CAST(list_min(q) AS BIGINT) AS worst FROM q",
    "processed_reads": f"""{_STREAM}, r AS (SELECT *, substr({_seq("'a' || id")}, 1, CASE WHEN ordinal % 5 = 0 THEN 20 ELSE 32 END) AS s FROM e),
        w AS (SELECT *, CASE WHEN length(s) < 26 THEN 'UMI: read1 has 20 bases, but 16 to 26 are needed' WHEN contains(substr(s, 1, 16), 'N') THEN 'Barcode holds an N' END AS reason FROM r)
        SELECT group_id, ordinal, CAST(1 AS BIGINT) AS gem_group, reason, CASE WHEN reason IS NULL THEN substr(s, 1, 16) END AS cb, CASE WHEN reason IS NULL THEN substr(s, 17, 10) END AS ub,
               CASE WHEN reason IS NOT NULL THEN 'c:' || id || ' 1:N' END AS refused, length(s) AS n1, {_qual('id')} AS q2 FROM w""",
    "catalog_trim": f"SELECT event_id AS ordinal, b AS s1, length(b) AS n1, b AS s2 FROM (SELECT event_id, translate(md5(CAST(event_id AS VARCHAR)), '{HEX}', 'CCGTTGGTCCTTGGCC') AS b FROM events)",
    "trimmed_fastq": f"""{_STREAM} SELECT group_id, ordinal, '@c:' || id || ' 1:N' || chr(10) || substr({_seq("'a' || id")}, 1, 12) || chr(10) || '+' || chr(10) || substr({_qual('id')}, 1, 12) AS text FROM e""",
    "change_dir": f"{_SETS1} SELECT {', '.join(f"'/elsewhere/' || split_part({r}, '/', -1) AS {r}" for r in ('r1', 'r2', 'i1', 'i2'))} FROM sets",
    "fasta_roundtrip": f"SELECT event_id AS id, {_seq('event_id')} AS seq FROM events",
    "json_adapters": """SELECT * FROM (VALUES ('R1', 'a', 'three_prime', 'anywhere', 'ACGTACGT', 'r1:0:16', 'r1:16:10', true), ('R2', 'b', 'five_prime', 'anchored', 'AAAAAAAA', NULL, NULL, NULL))
        AS t(read, name, "end", location, seq, barcode, umi, no_rna2)""",
    "fastq_faults": "SELECT 'a sequence holds something else than A, C, G, T or N' AS fault, true AS no_reads",
    "folder_files": "SELECT read, true AS there FROM (VALUES ('R1'), ('R2')) AS t(read)",
    "fastq_scan": "SELECT count(*) AS pairs, count(*) * 32 AS bases, count(*) AS headers FROM events",
} | {f"trim_homopolymer_{end[0:5].rstrip('_')}_{loc}": _poly(end, loc) for end in ENDS for loc in LOCATIONS}
