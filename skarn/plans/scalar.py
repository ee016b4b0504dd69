"""Scalar functions: strings, numbers, dates, JSON, arrays, escapes."""

from __future__ import annotations

from .spec import Query

STR = "(VALUES (1, 'Hello'), (2, 'Åäö x'), (3, ''), (4, NULL), (5, '  pad ')) AS t(id, s)"
NUMS = "(VALUES (1, 2.5, 7), (2, -2.5, -7), (3, 1234.567, 0), (4, -1.29, 3), (5, NULL, NULL)) AS t(id, x, n)"

STRINGS = [
    Query("f1_char_length", f"SELECT id, CHAR_LENGTH(s) AS a, CHARACTER_LENGTH(s) AS b, LENGTH(s) AS c FROM {STR}", f"SELECT id, CAST(length(s) AS INTEGER) AS a, CAST(length(s) AS INTEGER) AS b, CAST(length(s) AS INTEGER) AS c FROM {STR}"),
    Query("f2_octet_length", f"SELECT id, OCTET_LENGTH(s) AS n FROM {STR}", f"SELECT id, CAST(octet_length(encode(s)) AS INTEGER) AS n FROM {STR}"),
    Query("f3_position", "SELECT n_name, POSITION('_1' IN n_name) AS p, POSITION('' IN n_name) AS e FROM nation", "SELECT n_name, CAST(position('_1' IN n_name) AS INTEGER) AS p, 1 AS e FROM nation"),
    Query("f4_locate", "SELECT LOCATE('a', 'banana') AS a, LOCATE('a', 'banana', 3) AS b, LOCATE('a', 'banana', 0) AS c, LOCATE('z', 'banana') AS d", "SELECT 2 AS a, 4 AS b, 2 AS c, 0 AS d"),
    Query("f5_substring", "SELECT n_name, SUBSTRING(n_name FROM 3 FOR 4) AS a, SUBSTRING(n_name FROM 0 FOR 2) AS b, SUBSTRING(n_name, 100) AS c, SUBSTRING(n_name, -4, 3) AS d FROM nation", "SELECT n_name, substring(n_name, 3, 4) AS a, substring(n_name, 1, 2) AS b, '' AS c, substring(n_name, 1, 3) AS d FROM nation"),
    Query("f6_left_right", "SELECT p_partkey, LEFT(p_name, 3) AS l, RIGHT(p_name, 2) AS r FROM part"),
    Query("f7_concat", f"SELECT id, CONCAT(s, '-', NULL, id) AS c, CONCAT(NULL, NULL) IS NULL AS n FROM {STR}", f"SELECT id, concat(s, '-', NULL, id) AS c, TRUE AS n FROM {STR}"),
    Query("f8_pipes", f"SELECT id, s || '!' AS c, s || NULL AS n FROM {STR}", f"SELECT id, s || '!' AS c, CAST(NULL AS VARCHAR) AS n FROM {STR}"),
    Query("f9_case", f"SELECT id, UPPER(s) AS a, UCASE(s) AS b, LOWER(s) AS c, LCASE(s) AS d FROM {STR}"),
    Query("f10_trim", f"SELECT id, TRIM(s) AS a, TRIM(LEADING 'H' FROM s) AS b, LTRIM(s) AS c, RTRIM(s) AS d, LTRIM(s, 'He') AS e, TRIM(BOTH 'o' FROM s) AS f, TRIM(TRAILING 'o' FROM s) AS g FROM {STR}",
          f"SELECT id, trim(s, ' ') AS a, ltrim(s, 'H') AS b, ltrim(s, ' ') AS c, rtrim(s, ' ') AS d, ltrim(s, 'He') AS e, trim(s, 'o') AS f, rtrim(s, 'o') AS g FROM {STR}"),
    Query("f11_pad", "SELECT r_name, LPAD(r_name, 8, '*-') AS a, RPAD(r_name, 3, ' ') AS b FROM region"),
    Query("f12_overlay", "SELECT OVERLAY('abcdef' PLACING 'XX' FROM 2) AS a, OVERLAY('abcdef' PLACING 'X' FROM 2 FOR 3) AS b", "SELECT 'aXXdef' AS a, 'aXef' AS b"),
    Query("f13_replace", "SELECT n_name, REPLACE(n_name, 'NATION_', 'n') AS a, REPLACE(n_name, '', 'x') AS b FROM nation", "SELECT n_name, replace(n_name, 'NATION_', 'n') AS a, n_name AS b FROM nation"),
    Query("f14_insert", "SELECT r_name, INSERT(r_name, 2, 3, '__') AS a FROM region", "SELECT r_name, substring(r_name, 1, 1) || '__' || substring(r_name, 5) AS a FROM region"),
    Query("f15_repeat_space", "SELECT REPEAT('ab', 3) AS a, '[' || SPACE(2) || ']' AS b, REPEAT('x', -1) AS c", "SELECT 'ababab' AS a, '[  ]' AS b, '' AS c"),
    Query("f16_ascii", f"SELECT id, ASCII(s) AS a FROM {STR}", f"SELECT id, CASE WHEN s <> '' THEN CAST(unicode(s) AS INTEGER) END AS a FROM {STR}"),
    Query("f17_unicode", "SELECT UNICODE('Å') AS a, UNICODE('') AS b, UNICODE('x') AS c", "SELECT 197 AS a, 0 AS b, 120 AS c"),
    Query("f18_char", "SELECT CHAR(72, 105) AS a, CHAR(321) AS b, CHAR(65, NULL, 66) AS c", "SELECT 'Hi' AS a, 'Ł' AS b, 'AB' AS c"),
    Query("f19_normalize", "SELECT CHAR_LENGTH(NORMALIZE('é', NFD)) AS a, NORMALIZE('ﬁ', NFKC) AS b, NORMALIZE('é') AS c", "SELECT 2 AS a, 'fi' AS b, 'é' AS c"),
    Query("f20_soundex", "SELECT SOUNDEX('Robert') AS a, SOUNDEX('Rupert') AS b, SOUNDEX('Tymczak') AS c, SOUNDEX('Lee') AS d", "SELECT 'R163' AS a, 'R163' AS b, 'T520' AS c, 'L000' AS d"),
    Query("f21_difference", "SELECT DIFFERENCE('Smith', 'Smyth') AS a, DIFFERENCE('Green', 'Robert') AS b", "SELECT 4 AS a, 0 AS b"),
    Query("f22_convert_using", "SELECT CONVERT('Å' USING latin1) AS a, CONVERT('x' USING utf8) AS b", "SELECT 'Ã' || chr(133) AS a, 'x' AS b"),
    Query("f23_convert", "SELECT CONVERT('12', SQL_INTEGER) + 1 AS a, {fn CONVERT(3.7, SQL_VARCHAR)} AS b, CONVERT('2024-01-05', DATE) AS c", "SELECT 13 AS a, '3.7' AS b, DATE '2024-01-05' AS c"),
    Query("f24_collate", "SELECT r_name COLLATE sv_SE AS n FROM region", "SELECT r_name AS n FROM region"),
    Query("f25_coalesce", f"SELECT id, COALESCE(s, 'none') AS a, IFNULL(s, '?') AS b FROM {STR}", f"SELECT id, coalesce(s, 'none') AS a, coalesce(s, '?') AS b FROM {STR}"),
]

NUMBERS = [
    Query("n1_abs_ceil_floor", f"SELECT id, CAST(ABS(x) AS DOUBLE) AS a, CAST(CEIL(x) AS BIGINT) AS b, CAST(CEILING(x) AS BIGINT) AS c, CAST(FLOOR(x) AS BIGINT) AS d FROM {NUMS}"),
    Query("n2_round", f"SELECT id, CAST(ROUND(x) AS DOUBLE) AS a, CAST(ROUND(x, 1) AS DOUBLE) AS b, CAST(ROUND(x, -2) AS DOUBLE) AS c FROM {NUMS}"),
    Query("n3_trunc", f"SELECT id, CAST(TRUNC(x) AS DOUBLE) AS a, CAST(ROUND(TRUNCATE(x, 1), 6) AS DOUBLE) AS b FROM {NUMS}", "SELECT * FROM (VALUES (1, 2.0::DOUBLE, 2.5::DOUBLE), (2, -2, -2.5), (3, 1234, 1234.5), (4, -1, -1.2), (5, NULL, NULL)) AS t(id, a, b)"),
    Query("n4_sqrt", f"SELECT id, ROUND(SQRT(n), 8) AS a FROM {NUMS}", f"SELECT id, ROUND(CASE WHEN n >= 0 THEN sqrt(n) END, 8) AS a FROM {NUMS}"),
    Query("n5_mod", "SELECT p_partkey, MOD(p_size, 5) AS a, MOD(-p_size, 7) AS b, MOD(p_size, p_size - 10) AS c FROM part", "SELECT p_partkey, p_size % 5 AS a, -p_size % 7 AS b, p_size % nullif(p_size - 10, 0) AS c FROM part"),
    Query("n6_power_exp", f"SELECT id, POWER(n, 2) AS a, POW(2, 3) AS b, ROUND(EXP(1), 8) AS c FROM {NUMS}"),
    Query("n7_log", f"SELECT id, ROUND(LOG(abs(n) + 1), 8) AS a, LOG(n) IS NULL AS b, ROUND(LOG(2, 8), 8) AS c, LOG(1, 8) IS NULL AS d FROM {NUMS}", f"SELECT id, ROUND(ln(abs(n) + 1), 8) AS a, coalesce(n, 0) <= 0 AS b, 3.0::DOUBLE AS c, TRUE AS d FROM {NUMS}"),
    Query("n8_log10", "SELECT p_partkey, ROUND(LOG10(p_retailprice), 8) AS a FROM part"),
    Query("n9_rand", "SELECT COUNT(*) AS n FROM (SELECT RAND(3) AS r, RANDOM() AS q FROM nation) AS t WHERE r >= 0 AND r < 1 AND q >= 0 AND q < 1", "SELECT CAST(25 AS BIGINT) AS n"),
    Query("n10_sign", f"SELECT id, SIGN(n) AS a, SIGN(x) AS b FROM {NUMS}", f"SELECT id, CAST(sign(n) AS INTEGER) AS a, CAST(sign(x) AS INTEGER) AS b FROM {NUMS}"),
    Query("n11_trig", f"SELECT id, ROUND(SIN(n), 8) AS a, ROUND(COS(n), 8) AS b, ROUND(TAN(n), 8) AS c FROM {NUMS}"),
    Query("n12_cot", f"SELECT id, ROUND(COT(n), 6) AS a FROM {NUMS}", f"SELECT id, ROUND(1 / nullif(tan(n), 0), 6) AS a FROM {NUMS}"),
    Query("n13_arc", "SELECT ROUND(ASIN(0.5), 8) AS a, ROUND(ACOS(0.5), 8) AS b, ROUND(ATAN(2), 8) AS c, ROUND(ATAN2(1, 2), 8) AS d"),
    Query("n14_angles", "SELECT ROUND(DEGREES(PI()), 8) AS a, ROUND(RADIANS(180), 8) AS b, ROUND(PI(), 8) AS c"),
    Query("n15_unary", f"SELECT id, -n AS a, +n AS b, - -n AS c FROM {NUMS}", f"SELECT id, -n AS a, n AS b, n AS c FROM {NUMS}"),
]

DATES = [
    Query("d1_current", "SELECT CURRENT_DATE IS NOT NULL AS a, CURRENT_TIME IS NOT NULL AS b, CURRENT_TIMESTAMP() IS NOT NULL AS c, LOCALTIME IS NOT NULL AS d, LOCALTIMESTAMP IS NOT NULL AS e", "SELECT TRUE AS a, TRUE AS b, TRUE AS c, TRUE AS d, TRUE AS e"),
    Query("d2_parts", "SELECT event_id, YEAR(ts) AS y, MONTH(ts) AS m, QUARTER(ts) AS q, DAYOFMONTH(ts) AS dm, DAYOFYEAR(ts) AS dy, HOUR(ts) AS h, MINUTE(ts) AS mi, SECOND(ts) AS s FROM events",
          "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(quarter(ts) AS INTEGER) AS q, CAST(dayofmonth(ts) AS INTEGER) AS dm, CAST(dayofyear(ts) AS INTEGER) AS dy, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s FROM events"),
    Query("d3_day_of_week", "SELECT o_orderkey, DAYOFWEEK(o_orderdate) AS d FROM orders", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS d FROM orders"),
    Query("d4_week", "SELECT o_orderkey, WEEK(o_orderdate) AS w FROM orders", "SELECT o_orderkey, CAST(weekofyear(o_orderdate) AS INTEGER) AS w FROM orders"),
    Query("d5_extract", "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS m, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, EXTRACT(SECOND FROM ts) AS s FROM events",
          "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s FROM events"),
    Query("d5_extract_interval", "SELECT EXTRACT(HOUR FROM INTERVAL '29' HOUR) AS h, EXTRACT(DAY FROM INTERVAL '50' HOUR) AS d, EXTRACT(MINUTE FROM INTERVAL '2' HOUR) AS m", "SELECT 29 AS h, 2 AS d, 120 AS m"),
    Query("d6_timestampadd", "SELECT o_orderkey, TIMESTAMPADD(SQL_TSI_DAY, 10, o_orderdate) AS a, TIMESTAMPADD(MONTH, 1, o_orderdate) AS b, TIMESTAMPADD(SQL_TSI_HOUR, -5, o_orderdate) AS c, TIMESTAMPADD(QUARTER, 1, o_orderdate) AS d FROM orders",
          "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS a, o_orderdate + INTERVAL 1 MONTH AS b, o_orderdate - INTERVAL 5 HOUR AS c, o_orderdate + INTERVAL 3 MONTH AS d FROM orders"),
    Query("d6_timestampadd_date", "SELECT TIMESTAMPADD(SQL_TSI_MONTH, 1, DATE '2024-01-31') AS a", "SELECT DATE '2024-02-29' AS a"),
    Query("d7_timestampdiff", "SELECT event_id, TIMESTAMPDIFF(SQL_TSI_HOUR, TIMESTAMP '2020-01-01 00:00:00', ts) AS h, TIMESTAMPDIFF(DAY, TIMESTAMP '2020-01-01 00:00:00', ts) AS d FROM events", "SELECT event_id, datesub('hour', TIMESTAMP '2020-01-01 00:00:00', ts) AS h, datesub('day', TIMESTAMP '2020-01-01 00:00:00', ts) AS d FROM events"),
    Query("d8_interval_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL '1' DAY AS a, o_orderdate - INTERVAL '2' MONTH AS b, CAST('2024-02-28' AS DATE) + INTERVAL '1' DAY AS c FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b, DATE '2024-02-29' AS c FROM orders"),
    Query("d9_difference", "SELECT EXTRACT(DAY FROM DATE '2024-03-01' - DATE '2024-02-01') AS a, TIMESTAMP '2024-03-01 12:00:00' - TIMESTAMP '2024-02-29 12:00:00' = INTERVAL '1' DAY AS b", "SELECT 29 AS a, TRUE AS b"),
    Query("d10_interval_literals", "SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '2 03:04:05' DAY TO SECOND AS a, DATE '2024-01-01' + INTERVAL '1-2' YEAR TO MONTH AS b", "SELECT TIMESTAMP '2024-01-03 03:04:05' AS a, DATE '2025-03-01' AS b"),
    Query("d12_epoch_millis", "SELECT o_orderkey, CAST(o_orderkey * 86400000 AS DATE) AS d, CAST(CAST(o_orderkey * 86400000 + 1500 AS TIMESTAMP) AS STRING) AS t FROM orders",
          "SELECT o_orderkey, DATE '1970-01-01' + CAST(o_orderkey AS INTEGER) AS d, strftime(epoch_ms(o_orderkey * 86400000 + 1500), '%Y-%m-%d %H:%M:%S.5') AS t FROM orders"),
    Query("n4_once", "SELECT COUNT(*) AS n FROM lineitem WHERE SQRT(RAND() - 0.5) = CAST('NaN' AS DOUBLE)", "SELECT CAST(0 AS BIGINT) AS n"),
    Query("d11_cast", "SELECT CAST('true' AS BOOLEAN) AS a, CAST('abcdef' AS VARCHAR(3)) AS b, CAST(12 AS TEXT) AS c, CAST('7' AS int2) AS d, CAST('8' AS int4) AS e, CAST(9 AS int8) AS f, CAST('1.5' AS float8) AS g, CAST('2.345' AS DECIMAL(5, 2)) AS h, CAST('2024-02-29' AS DATE) AS i, CAST(5 AS signed) AS j",
          "SELECT TRUE AS a, 'abc' AS b, '12' AS c, CAST(7 AS SMALLINT) AS d, 8 AS e, CAST(9 AS BIGINT) AS f, CAST(1.5 AS DOUBLE) AS g, CAST('2.345' AS DECIMAL(5, 2)) AS h, DATE '2024-02-29' AS i, CAST(5 AS BIGINT) AS j"),
    Query("d11_cast_time", "SELECT CAST(CAST('12:30:05' AS TIME) AS VARCHAR(20)) AS t", "SELECT '12:30:05' AS t"),
]

JSON = [
    Query("x1_json_value", "SELECT JSON_VALUE('{\"a\": {\"b\": [1, \"two\"]}, \"c\": true}', '$.a.b[1]') AS a, JSON_VALUE('{\"c\": true}', '$.c') AS b, JSON_VALUE('{\"c\": 1}', '$.x') AS c", "SELECT 'two' AS a, 'true' AS b, CAST(NULL AS VARCHAR) AS c"),
    Query("x1_json_value_column", "SELECT event_id, JSON_VALUE(props, '$.k') AS v FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events"),
    Query("x2_json_query", "SELECT JSON_QUERY('{\"a\": {\"b\": [1, 2]}}', '$.a') AS a, JSON_QUERY('{\"a\": \"s\"}', '$.a') AS b", "SELECT '{\"b\":[1,2]}' AS a, '\"s\"' AS b"),
    Query("x3_json_object", "SELECT JSON_OBJECT('a', 1, 'b', NULL) AS a, JSON_OBJECT(KEY 'k' VALUE 'v', KEY 'n' VALUE n_nationkey) AS b, JSON_OBJECT('j', '{\"x\": 1}') AS c FROM nation WHERE n_nationkey = 3", "SELECT '{\"a\":1,\"b\":null}' AS a, '{\"k\":\"v\",\"n\":3}' AS b, '{\"j\":{\"x\":1}}' AS c"),
    Query("x4_json_array", "SELECT JSON_ARRAY(1, 'x', NULL, 2.5) AS a, JSON_ARRAY() AS b", "SELECT '[1,\"x\",null,2.5]' AS a, '[]' AS b"),
]

OTHERS = [
    Query("y1_array", "SELECT size(ARRAY[1, 2, 3]) AS n, element_at(ARRAY[1, 2.5], 1) = 1 AS first_is_one, element_at(ARRAY('a', 'b'), 2) AS b", "SELECT 3 AS n, TRUE AS first_is_one, 'b' AS b"),
    Query("y2_array_query", "SELECT array_join(ARRAY(SELECT r_name FROM region ORDER BY r_name DESC), ',') AS names, size(ARRAY(SELECT b FROM (VALUES (1, 10), (2, NULL)) AS t(a, b))) AS n", "SELECT string_agg(r_name, ',' ORDER BY r_name DESC) AS names, 2 AS n FROM region"),
    Query("y3_system", "SELECT DATABASE() IS NOT NULL AS d, USER() IS NOT NULL AS u, SYSTEM_USER IS NOT NULL AS s", "SELECT TRUE AS d, TRUE AS u, TRUE AS s"),
    Query("y4_escapes", "SELECT {fn UCASE(r_name)} AS a, {fn LENGTH({fn CONCAT(r_name, '!')})} AS b, {d '2024-02-29'} AS c, {fn MOD(r_regionkey, 2)} AS d FROM region", "SELECT upper(r_name) AS a, CAST(length(r_name) + 1 AS INTEGER) AS b, DATE '2024-02-29' AS c, r_regionkey % 2 AS d FROM region"),
]

QUERIES = [*STRINGS, *NUMBERS, *DATES, *JSON, *OTHERS]
