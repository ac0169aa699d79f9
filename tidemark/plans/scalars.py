"""Scalar function families: one query for each, a column for each function. The Spark side is built through the
function catalogue, the SQL twin is written out beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from tidemark import functions as F
from tidemark.plans.registry import register, table

C, L = F.col, F.lit
Pairs = dict[str, tuple[Callable[[], Column], str]]


def family(name: str, source: str, key: str, pairs: Pairs, where: str | None = None, view: str | None = None, prepare=None) -> None:
    """Register a projection of key and the pairs. view is the SQL source where prepare derives it."""
    columns = ", ".join(f"{sql} AS {alias}" for alias, (_, sql) in pairs.items())

    @register(name, f"SELECT {key}, {columns} FROM {view or source}" + (f" WHERE {where}" if where else ""))
    def query(spark, d):
        t = table(spark, d, source)
        t = prepare(t) if prepare else t
        return (t.filter(where) if where else t).select(key, *[f().alias(alias) for alias, (f, _) in pairs.items()])


def unchecked(name: str, source: str, key: str, columns: dict[str, Callable[[], Column]], where: str | None = None, of: str | None = None) -> None:
    """Functions without a twin in the other engine: pinned values are in the tests. Costly functions of one column, of, are
    evaluated once for each of its values, which are dealt over the tasks by number: by size they would all go to a few."""

    @register(name)
    def query(spark, d):
        t = table(spark, d, source)
        t = t.filter(where) if where else t
        found = [f().alias(alias) for alias, f in columns.items()]
        if of is None:
            return t.select(key, *found)
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        by_value = t.select(of).distinct().repartition(tasks).select(C(of).alias("__of"), *found)
        # What is shuffled has been evaluated: in a join's generated code it would be anew for each row that it meets. Not by
        # key: such an exchange is left out where the rows are dealt so already.
        by_value = by_value.repartition(tasks)
        return t.select(key, of).join(by_value, C(of).eqNullSafe(C("__of"))).select(key, *columns)


n, b, ty = (lambda: C("p_name")), (lambda: C("p_brand")), (lambda: C("p_type"))

family("string_case_and_trim", "part", "p_partkey", {
    "upper_": (lambda: F.upper("p_name"), "upper(p_name)"),
    "lower_": (lambda: F.lower("p_type"), "lower(p_type)"),
    "ucase_": (lambda: F.ucase(n()), "upper(p_name)"),
    "lcase_": (lambda: F.lcase(ty()), "lower(p_type)"),
    "initcap_": (lambda: F.initcap("p_name"), "upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]"),
    "trim_": (lambda: F.trim(F.concat(L("  "), n(), L(" "))), "trim('  ' || p_name || ' ')"),
    "ltrim_": (lambda: F.ltrim(F.concat(L("  "), n())), "ltrim('  ' || p_name)"),
    "rtrim_": (lambda: F.rtrim(F.concat(n(), L("  "))), "rtrim(p_name || '  ')"),
    "btrim_": (lambda: F.btrim(n(), L("rt")), "trim(p_name, 'rt')"),
    "lpad_": (lambda: F.lpad("p_name", 14, "*"), "lpad(p_name, 14, '*')"),
    "rpad_": (lambda: F.rpad("p_name", 14, "-"), "rpad(p_name, 14, '-')"),
    "reverse_": (lambda: F.reverse("p_name"), "reverse(p_name)"),
    "repeat_": (lambda: F.repeat("p_brand", 2), "repeat(p_brand, 2)"),
})
family("string_parts", "part", "p_partkey", {
    "length_": (lambda: F.length("p_name"), "CAST(length(p_name) AS INTEGER)"),
    "char_length_": (lambda: F.char_length(n()), "CAST(length(p_name) AS INTEGER)"),
    "octet_": (lambda: F.octet_length("p_name"), "CAST(strlen(p_name) AS INTEGER)"),
    "bits_": (lambda: F.bit_length("p_name"), "CAST(bit_length(p_name) AS INTEGER)"),
    "substring_": (lambda: F.substring("p_name", 2, 3), "substring(p_name, 2, 3)"),
    "substr_": (lambda: F.substr(n(), L(3)), "substring(p_name, 3)"),
    "left_": (lambda: F.left(n(), L(3)), "left(p_name, 3)"),
    "right_": (lambda: F.right(n(), L(3)), "right(p_name, 3)"),
    "split_": (lambda: F.split("p_name", " "), "string_split(p_name, ' ')"),
    "split_part_": (lambda: F.split_part(b(), L("#"), L(2)), "split_part(p_brand, '#', 2)"),
    "substring_index_": (lambda: F.substring_index("p_name", " ", 1), "split_part(p_name, ' ', 1)"),
    "instr_": (lambda: F.instr("p_name", "e"), "CAST(instr(p_name, 'e') AS INTEGER)"),
    "locate_": (lambda: F.locate("r", "p_name"), "CAST(instr(p_name, 'r') AS INTEGER)"),
    "position_": (lambda: F.position(L("d"), n()), "CAST(instr(p_name, 'd') AS INTEGER)"),
    "ascii_": (lambda: F.ascii("p_name"), "CAST(ascii(p_name) AS INTEGER)"),
    "char_": (lambda: F.char(C("p_size") + 64), "chr(p_size + 64)"),
    "elt_": (lambda: F.elt(2, "p_name", "p_brand"), "p_brand"),
    "find_in_set_": (lambda: F.find_in_set(ty(), L("ECONOMY,PROMO,STANDARD")), "CAST(coalesce(list_position(['ECONOMY', 'PROMO', 'STANDARD'], p_type), 0) AS INTEGER)"),
})
family("string_build_and_compare", "part", "p_partkey", {
    "concat_": (lambda: F.concat("p_name", L("/"), "p_brand"), "p_name || '/' || p_brand"),
    "concat_ws_": (lambda: F.concat_ws("-", "p_name", "p_type"), "concat_ws('-', p_name, p_type)"),
    "format_": (lambda: F.format_string("%s has %d", "p_name", "p_size"), "printf('%s has %d', p_name, p_size)"),
    "printf_": (lambda: F.printf(L("%05d"), C("p_size")), "printf('%05d', p_size)"),
    "translate_": (lambda: F.translate("p_name", "aei", "123"), "translate(p_name, 'aei', '123')"),
    "replace_": (lambda: F.replace(n(), L("e"), L("E")), "replace(p_name, 'e', 'E')"),
    "overlay_": (lambda: F.overlay("p_name", L("##"), 2, 1), "p_name[1] || '##' || p_name[3:]"),
    "contains_": (lambda: F.contains(n(), L("ed")), "contains(p_name, 'ed')"),
    "startswith_": (lambda: F.startswith(n(), L("s")), "starts_with(p_name, 's')"),
    "endswith_": (lambda: F.endswith(n(), L("t")), "suffix(p_name, 't')"),
    "like_": (lambda: F.like(n(), L("%in%")), "p_name LIKE '%in%'"),
    "ilike_": (lambda: F.ilike(n(), L("%IN%")), "p_name ILIKE '%IN%'"),
    "levenshtein_": (lambda: F.levenshtein("p_name", "p_brand"), "CAST(levenshtein(p_name, p_brand) AS INTEGER)"),
    "isin_": (lambda: F.isin("p_type", "ECONOMY", "PROMO"), "p_type IN ('ECONOMY', 'PROMO')"),
    "to_varchar_": (lambda: F.to_varchar("p_name", 4), "left(p_name, 4)"),
})
family("string_regexp", "part", "p_partkey", {
    "replace_": (lambda: F.regexp_replace("p_name", "[aeiou]+", "_"), "regexp_replace(p_name, '[aeiou]+', '_', 'g')"),
    "extract_": (lambda: F.regexp_extract("p_name", r"(\w+) (\w+)", 2), r"regexp_extract(p_name, '(\w+) (\w+)', 2)"),
    "extract_all_": (lambda: F.regexp_extract_all(n(), L("[a-z]e"), L(0)), "regexp_extract_all(p_name, '[a-z]e')"),
    "count_": (lambda: F.regexp_count(n(), L("[aeiou]")), "CAST(length(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER)"),
    "like_": (lambda: F.regexp_like(n(), L("^[a-m]")), "regexp_matches(p_name, '^[a-m]')"),
    "rlike_": (lambda: F.rlike(n(), L("t$")), "regexp_matches(p_name, 't$')"),
    "regexp_": (lambda: F.regexp(n(), L("o")), "regexp_matches(p_name, 'o')"),
    "substr_": (lambda: F.regexp_substr("p_name", "[aeiou]", 1, 2), "regexp_extract_all(p_name, '[aeiou]')[2]"),
    "instr_": (lambda: F.regexp_instr("p_name", "[aeiou]"), "CAST(coalesce(length(regexp_extract(p_name, '^[^aeiou]*')) + 1, 0) AS INTEGER)"),
})
family("string_encodings", "part", "p_partkey", {
    "md5_": (lambda: F.md5("p_name"), "md5(p_name)"),
    "sha1_": (lambda: F.sha1("p_name"), "sha1(p_name)"),
    "sha_": (lambda: F.sha(n()), "sha1(p_name)"),
    "sha2_": (lambda: F.sha2("p_name", 256), "sha256(p_name)"),
    "hex_": (lambda: F.hex("p_name"), "upper(hex(encode(p_name)))"),
    "unhex_": (lambda: F.decode(F.unhex(F.hex("p_name")), "UTF-8"), "p_name"),
    "base64_": (lambda: F.base64(F.encode("p_name", "UTF-8")), "base64(encode(p_name))"),
    "unbase64_": (lambda: F.decode(F.unbase64(F.base64("p_name")), "UTF-8"), "p_name"),
    "bin_": (lambda: F.bin("p_size"), "bin(p_size)"),
    "conv_": (lambda: F.conv(C("p_size").cast("string"), 10, 16), "upper(hex(p_size))"),
    "url_encode_": (lambda: F.url_encode(b()), "url_encode(p_brand)"),
    "url_decode_": (lambda: F.url_decode(F.url_encode(b())), "p_brand"),
})
unchecked("string_unmatched", "part", "p_partkey", {
    "soundex_": lambda: F.soundex("p_name"), "crc32_": lambda: F.crc32(C("p_name").cast("binary")), "hash_": lambda: F.hash("p_name"),
    "xxhash_": lambda: F.xxhash64("p_name"), "mask_": lambda: F.mask(b()), "sentences_": lambda: F.size(F.sentences("p_name")),
    "format_number_": lambda: F.format_number("p_retailprice", 2), "to_char_": lambda: F.to_char(C("p_size"), L("999")),
    "parse_url_": lambda: F.parse_url(F.concat(L("http://a.b/c?d="), F.url_encode(n())), L("QUERY")), "typeof_": lambda: F.typeof("p_size"),
    "aes_": lambda: F.aes_decrypt(F.aes_encrypt(n(), L("0123456789abcdef")), L("0123456789abcdef")).cast("string"),
    "try_aes_": lambda: F.try_aes_decrypt(C("p_name").cast("binary"), L("0123456789abcdef")), "user_": lambda: F.length(F.user()) > 0,
})

x, y = (lambda: C("s_acctbal")), (lambda: C("s_suppkey"))


def _m(f: Callable[[], Column], sql: str):
    return (lambda: F.round(f(), 6)), f"round({sql}, 6)"


family("math_functions", "supplier", "s_suppkey", {
    "abs_": _m(lambda: F.abs("s_acctbal"), "abs(s_acctbal)"), "sqrt_": _m(lambda: F.sqrt(F.abs("s_acctbal")), "sqrt(abs(s_acctbal))"),
    "cbrt_": _m(lambda: F.cbrt("s_acctbal"), "cbrt(s_acctbal)"), "exp_": _m(lambda: F.exp(x() / 10000), "exp(s_acctbal / 10000)"),
    "expm1_": _m(lambda: F.expm1(x() / 10000), "exp(s_acctbal / 10000) - 1"), "ln_": _m(lambda: F.ln(F.abs("s_acctbal") + 1), "ln(abs(s_acctbal) + 1)"),
    "log_": _m(lambda: F.log(3.0, F.abs("s_acctbal") + 1), "ln(abs(s_acctbal) + 1) / ln(3)"), "log10_": _m(lambda: F.log10(F.abs("s_acctbal") + 1), "log10(abs(s_acctbal) + 1)"),
    "log2_": _m(lambda: F.log2(F.abs("s_acctbal") + 1), "log2(abs(s_acctbal) + 1)"), "log1p_": _m(lambda: F.log1p(F.abs("s_acctbal")), "ln(1 + abs(s_acctbal))"),
    "pow_": _m(lambda: F.pow(x() / 1000, 3), "pow(s_acctbal / 1000, 3)"), "power_": _m(lambda: F.power(x() / 1000, 2), "power(s_acctbal / 1000, 2)"),
    "sin_": _m(lambda: F.sin("s_suppkey"), "sin(s_suppkey)"), "cos_": _m(lambda: F.cos("s_suppkey"), "cos(s_suppkey)"), "tan_": _m(lambda: F.tan(y() / 100), "tan(s_suppkey / 100)"),
    "cot_": _m(lambda: F.cot(y() / 100 + 1), "cot(s_suppkey / 100 + 1)"), "sec_": _m(lambda: F.sec(y() / 100), "1 / cos(s_suppkey / 100)"), "csc_": _m(lambda: F.csc(y() / 100 + 1), "1 / sin(s_suppkey / 100 + 1)"),
    "asin_": _m(lambda: F.asin(y() / 100), "asin(s_suppkey / 100)"), "acos_": _m(lambda: F.acos(y() / 100), "acos(s_suppkey / 100)"), "atan_": _m(lambda: F.atan("s_suppkey"), "atan(s_suppkey)"),
    "atan2_": _m(lambda: F.atan2("s_acctbal", "s_suppkey"), "atan2(s_acctbal, s_suppkey)"), "sinh_": _m(lambda: F.sinh(y() / 100), "sinh(s_suppkey / 100)"), "cosh_": _m(lambda: F.cosh(y() / 100), "cosh(s_suppkey / 100)"),
    "tanh_": _m(lambda: F.tanh(y() / 100), "tanh(s_suppkey / 100)"), "asinh_": _m(lambda: F.asinh("s_suppkey"), "asinh(s_suppkey)"), "acosh_": _m(lambda: F.acosh(y() + 1), "acosh(s_suppkey + 1)"),
    "atanh_": _m(lambda: F.atanh(y() / 101), "atanh(s_suppkey / 101)"), "degrees_": _m(lambda: F.degrees("s_suppkey"), "degrees(s_suppkey)"), "radians_": _m(lambda: F.radians("s_suppkey"), "radians(s_suppkey)"),
    "hypot_": _m(lambda: F.hypot("s_acctbal", "s_suppkey"), "sqrt(s_acctbal * s_acctbal + s_suppkey * s_suppkey)"), "e_": _m(lambda: F.e(), "exp(1)"), "pi_": _m(lambda: F.pi(), "pi()"),
    "toDegrees_": _m(lambda: F.toDegrees("s_suppkey"), "degrees(s_suppkey)"), "toRadians_": _m(lambda: F.toRadians("s_suppkey"), "radians(s_suppkey)"),
})
family("math_integers", "supplier", "s_suppkey", {
    "ceil_": (lambda: F.ceil("s_acctbal"), "CAST(ceil(s_acctbal) AS BIGINT)"), "ceiling_": (lambda: F.ceiling(x()), "CAST(ceil(s_acctbal) AS BIGINT)"),
    "floor_": (lambda: F.floor("s_acctbal"), "CAST(floor(s_acctbal) AS BIGINT)"), "round_": (lambda: F.round("s_acctbal", 1), "round(s_acctbal, 1)"),
    "rint_": (lambda: F.rint("s_acctbal"), "round_even(s_acctbal, 0)"), "sign_": (lambda: F.sign("s_acctbal"), "CAST(sign(s_acctbal) AS DOUBLE)"),
    "signum_": (lambda: F.signum("s_acctbal"), "CAST(sign(s_acctbal) AS DOUBLE)"), "negative_": (lambda: F.negative("s_suppkey"), "-s_suppkey"),
    "positive_": (lambda: F.positive("s_suppkey"), "s_suppkey"), "negate_": (lambda: F.negate("s_suppkey"), "-s_suppkey"), "pmod_": (lambda: F.pmod(-y(), L(7)), "((-s_suppkey % 7) + 7) % 7"),
    "factorial_": (lambda: F.factorial(y() % 15), "CAST(factorial(CAST(s_suppkey % 15 AS INTEGER)) AS BIGINT)"), "greatest_": (lambda: F.greatest("s_suppkey", L(50)), "greatest(s_suppkey, 50)"),
    "least_": (lambda: F.least("s_suppkey", L(50)), "least(s_suppkey, 50)"), "bit_count_": (lambda: F.bit_count("s_suppkey"), "CAST(bit_count(s_suppkey) AS INTEGER)"),
    "and_": (lambda: y().bitwiseAND(12), "s_suppkey & 12"), "or_": (lambda: y().bitwiseOR(12), "s_suppkey | 12"), "xor_": (lambda: y().bitwiseXOR(12), "xor(s_suppkey, 12)"),
    "not_": (lambda: F.bitwise_not("s_suppkey"), "~s_suppkey"), "bitwiseNOT_": (lambda: F.bitwiseNOT("s_suppkey"), "~s_suppkey"), "shl_": (lambda: F.shiftleft("s_suppkey", 3), "s_suppkey << 3"),
    "shr_": (lambda: F.shiftright("s_suppkey", 2), "s_suppkey >> 2"), "shru_": (lambda: F.shiftrightunsigned("s_suppkey", 1), "s_suppkey >> 1"), "shiftLeft_": (lambda: F.shiftLeft("s_suppkey", 3), "s_suppkey << 3"),
    "getbit_": (lambda: F.getbit(y(), L(1)), "CAST((s_suppkey >> 1) & 1 AS TINYINT)"), "bit_get_": (lambda: F.bit_get(y(), L(0)), "CAST(s_suppkey & 1 AS TINYINT)"),
})
unchecked("math_unmatched", "supplier", "s_suppkey", {
    "bround_": lambda: F.bround("s_acctbal", 1), "width_bucket_": lambda: F.width_bucket(x(), L(-1000.0), L(10000.0), L(10)), "rand_": lambda: F.rand(7) < 1, "randn_": lambda: F.randn(7).isNotNull(),
    "nanvl_": lambda: F.nanvl("s_acctbal", L(0.0)), "pos_": lambda: F.bitmap_bit_position(y()), "bucket_": lambda: F.bitmap_bucket_number(y()),
})

family("conditional_functions", "events", "event_id", {
    "nullif_": (lambda: F.nullif(C("event_type"), L("error")), "nullif(event_type, 'error')"), "coalesce_": (lambda: F.coalesce(F.nullif(C("event_type"), L("error")), L("none")), "coalesce(nullif(event_type, 'error'), 'none')"),
    "nvl_": (lambda: F.nvl(F.nullif(C("event_type"), L("view")), L("x")), "ifnull(nullif(event_type, 'view'), 'x')"), "ifnull_": (lambda: F.ifnull(F.nullif(C("event_type"), L("view")), L("x")), "ifnull(nullif(event_type, 'view'), 'x')"),
    "nvl2_": (lambda: F.nvl2(F.nullif(C("event_type"), L("view")), L(1), L(2)), "CASE WHEN nullif(event_type, 'view') IS NOT NULL THEN 1 ELSE 2 END"),
    "isnull_": (lambda: F.isnull(F.nullif(C("event_type"), L("view"))), "event_type = 'view'"), "isnotnull_": (lambda: F.isnotnull(F.nullif(C("event_type"), L("view"))), "event_type <> 'view'"),
    "isnan_": (lambda: F.isnan("value"), "isnan(value)"), "equal_null_": (lambda: F.equal_null(F.nullif(C("event_type"), L("view")), L(None)), "nullif(event_type, 'view') IS NULL"),
    "when_": (lambda: F.when(C("value") > 50, "high").otherwise("low"), "CASE WHEN value > 50 THEN 'high' ELSE 'low' END"),
    "try_divide_": (lambda: F.try_divide("value", C("user_id") % 2), "value / nullif(user_id % 2, 0)"), "try_add_": (lambda: F.try_add("user_id", L(1)), "user_id + 1"),
    "try_subtract_": (lambda: F.try_subtract("user_id", L(1)), "user_id - 1"), "try_multiply_": (lambda: F.try_multiply("user_id", L(3)), "user_id * 3"),
    "cast_": (lambda: F.cast("event_type", "int"), "TRY_CAST(event_type AS INTEGER)"), "between_": (lambda: C("value").between(10, 20), "value BETWEEN 10 AND 20"),
})

t = lambda: C("o_orderdate")
z = lambda: C("ts").cast("timestamp")
family("date_parts", "orders", "o_orderkey", {
    "year_": (lambda: F.year(t()), "CAST(year(o_orderdate) AS INTEGER)"), "quarter_": (lambda: F.quarter(t()), "CAST(quarter(o_orderdate) AS INTEGER)"), "month_": (lambda: F.month(t()), "CAST(month(o_orderdate) AS INTEGER)"),
    "day_": (lambda: F.day(t()), "CAST(day(o_orderdate) AS INTEGER)"), "dayofmonth_": (lambda: F.dayofmonth(t()), "CAST(day(o_orderdate) AS INTEGER)"), "dayofweek_": (lambda: F.dayofweek(t()), "CAST(dayofweek(o_orderdate) + 1 AS INTEGER)"),
    "dayofyear_": (lambda: F.dayofyear(t()), "CAST(dayofyear(o_orderdate) AS INTEGER)"), "weekofyear_": (lambda: F.weekofyear(t()), "CAST(weekofyear(o_orderdate) AS INTEGER)"), "weekday_": (lambda: F.weekday(t()), "CAST(isodow(o_orderdate) - 1 AS INTEGER)"),
    "dayname_": (lambda: F.dayname(t().cast("date")), "left(dayname(o_orderdate), 3)"), "extract_": (lambda: F.extract(L("YEAR"), t()), "CAST(year(o_orderdate) AS INTEGER)"), "date_part_": (lambda: F.date_part(L("MONTH"), t()), "CAST(month(o_orderdate) AS INTEGER)"),
    "datepart_": (lambda: F.datepart("DAY", t()), "CAST(day(o_orderdate) AS INTEGER)"), "last_day_": (lambda: F.last_day(t()), "last_day(o_orderdate)"), "trunc_": (lambda: F.trunc(t(), "month"), "CAST(date_trunc('month', o_orderdate) AS DATE)"),
    "format_": (lambda: F.date_format(t(), "yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"),
})
family("date_arithmetic", "orders", "o_orderkey", {
    "add_": (lambda: F.date_add(t(), 10), "CAST(o_orderdate AS DATE) + 10"), "sub_": (lambda: F.date_sub(t(), 10), "CAST(o_orderdate AS DATE) - 10"), "dateadd_": (lambda: F.dateadd(t(), L(3)), "CAST(o_orderdate AS DATE) + 3"),
    "add_months_": (lambda: F.add_months(t(), 2), "CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE)"), "datediff_": (lambda: F.datediff(L("2000-01-01").cast("date"), t()), "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER)"),
    "date_diff_": (lambda: F.date_diff(L("2000-01-01").cast("date"), t()), "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER)"), "unix_date_": (lambda: F.unix_date(t().cast("date")), "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER)"),
    "from_unix_date_": (lambda: F.date_from_unix_date(C("o_orderkey").cast("int")), "DATE '1970-01-01' + CAST(o_orderkey AS INTEGER)"), "make_date_": (lambda: F.make_date(F.year(t()), L(2), L(3)), "make_date(year(o_orderdate), 2, 3)"),
    "to_date_": (lambda: F.to_date(F.date_format(t(), "dd/MM/yyyy"), "dd/MM/yyyy"), "CAST(o_orderdate AS DATE)"), "next_day_": (lambda: F.next_day(t(), "MO"), "CAST(o_orderdate AS DATE) + CAST(8 - isodow(o_orderdate) AS INTEGER)"),
    "timestampdiff_": (lambda: F.timestampdiff("DAY", t(), L("2002-01-01 00:00:00")), "date_diff('day', o_orderdate, TIMESTAMP '2002-01-01')"),
})
family("timestamp_functions", "events", "event_id", {
    "hour_": (lambda: F.hour(z()), "CAST(hour(ts) AS INTEGER)"), "minute_": (lambda: F.minute(z()), "CAST(minute(ts) AS INTEGER)"), "second_": (lambda: F.second(z()), "CAST(second(ts) AS INTEGER)"),
    "trunc_": (lambda: F.date_trunc("hour", z()).cast("timestamp_ntz"), "date_trunc('hour', ts)"), "seconds_": (lambda: F.unix_seconds(z()), "CAST(floor(epoch(ts)) AS BIGINT)"), "millis_": (lambda: F.unix_millis(z()), "epoch_us(ts) // 1000"),
    "micros_": (lambda: F.unix_micros(z()), "epoch_us(ts)"), "unix_": (lambda: F.unix_timestamp(z()), "CAST(floor(epoch(ts)) AS BIGINT)"), "to_unix_": (lambda: F.to_unix_timestamp(z()), "CAST(floor(epoch(ts)) AS BIGINT)"),
    "from_unix_": (lambda: F.from_unixtime(F.unix_seconds(z())), "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')"), "of_seconds_": (lambda: F.timestamp_seconds(C("user_id")).cast("timestamp_ntz"), "make_timestamp(user_id * 1000000)"),
    "of_millis_": (lambda: F.timestamp_millis(C("user_id")).cast("timestamp_ntz"), "make_timestamp(user_id * 1000)"), "of_micros_": (lambda: F.timestamp_micros(C("user_id")).cast("timestamp_ntz"), "make_timestamp(user_id)"),
    "add_": (lambda: F.timestampadd("HOUR", 5, z()).cast("timestamp_ntz"), "ts + INTERVAL 5 HOUR"), "add_months_": (lambda: F.timestampadd("MONTH", 2, z()).cast("timestamp_ntz"), "ts + INTERVAL 2 MONTH"),
    "diff_": (lambda: F.timestampdiff("HOUR", L("2024-01-01 00:00:00"), z()), "date_sub('hour', TIMESTAMP '2024-01-01', ts)"), "to_ts_": (lambda: F.to_timestamp_ntz(F.date_format(z(), "yyyy-MM-dd HH:mm:ss")), "date_trunc('second', ts)"),
    "make_": (lambda: F.make_timestamp_ntz(L(2024), L(1), F.day(z()), F.hour(z()), L(0), L(0)), "make_timestamp(2024, 1, day(ts), hour(ts), 0, 0)"), "days_": (lambda: (z() + F.days(L(2))).cast("timestamp_ntz"), "ts + INTERVAL 2 DAY"),
    "hours_": (lambda: (z() + F.hours(L(2))).cast("timestamp_ntz"), "ts + INTERVAL 2 HOUR"), "months_": (lambda: (z() + F.months(L(1))).cast("timestamp_ntz"), "ts + INTERVAL 1 MONTH"), "years_": (lambda: (z() + F.years(L(1))).cast("timestamp_ntz"), "ts + INTERVAL 1 YEAR"),
})
unchecked("timestamp_unmatched", "events", "event_id", {
    "from_utc_": lambda: F.from_utc_timestamp(z(), "Asia/Tokyo"), "to_utc_": lambda: F.to_utc_timestamp(z(), "Asia/Tokyo"), "convert_": lambda: F.convert_timezone(L("UTC"), L("Asia/Tokyo"), C("ts")),
    "between_": lambda: F.months_between(z(), L("2024-01-01").cast("timestamp")), "now_": lambda: F.now() >= z(), "today_": lambda: F.current_date() >= F.to_date(z()), "curdate_": lambda: F.curdate() == F.current_date(),
    "zone_": lambda: F.current_timezone(), "local_": lambda: F.localtimestamp().isNotNull(), "current_": lambda: F.current_timestamp().isNotNull(), "dt_": lambda: F.make_dt_interval(L(1), L(2)).cast("string"), "ym_": lambda: F.make_ym_interval(L(1), L(2)).cast("string"),
    "ltz_": lambda: F.to_timestamp_ltz(L("2024-01-02 03:04:05")), "make_ltz_": lambda: F.make_timestamp_ltz(L(2024), L(1), L(2), L(3), L(4), L(5)), "try_ts_": lambda: F.try_to_timestamp(L("no date")),
})
