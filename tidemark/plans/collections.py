"""Arrays, maps, structs, generators, JSON, CSV and XML."""

from __future__ import annotations

from tidemark import functions as F
from tidemark.plans.registry import register, table
from tidemark.plans.scalars import C, L, family, unchecked

A, B = (lambda: F.split("p_name", "")), (lambda: F.split("p_type", ""))
_A, _B = "string_split(p_name, '')", "string_split(p_type, '')"


def _ints():
    return F.sequence(L(1), C("p_size") % 6 + 1)


_I = "range(1, p_size % 6 + 2)"

family("array_functions", "part", "p_partkey", {
    "size_": (lambda: F.size(_ints()), f"CAST(length({_I}) AS INTEGER)"), "array_size_": (lambda: F.array_size(_ints()), f"CAST(length({_I}) AS INTEGER)"), "cardinality_": (lambda: F.cardinality(_ints()), f"CAST(length({_I}) AS INTEGER)"),
    "contains_": (lambda: F.array_contains(_ints(), 3), f"list_contains({_I}, 3)"), "position_": (lambda: F.array_position(_ints(), 3), f"CAST(coalesce(list_position({_I}, 3), 0) AS BIGINT)"),
    "max_": (lambda: F.array_max(_ints()).cast("bigint"), f"list_max({_I})"), "min_": (lambda: F.array_min(_ints()).cast("bigint"), f"list_min({_I})"), "join_": (lambda: F.array_join(F.split("p_name", " "), "+"), "replace(p_name, ' ', '+')"),
    "element_": (lambda: F.element_at(F.split("p_name", " "), 1), "string_split(p_name, ' ')[1]"), "try_element_": (lambda: F.try_element_at(F.split("p_name", " "), L(9)), "string_split(p_name, ' ')[9]"), "get_": (lambda: F.get(F.split("p_name", " "), 1), "string_split(p_name, ' ')[2]"),
    "slice_": (lambda: F.slice(F.split("p_name", " "), 1, 1), "string_split(p_name, ' ')[1:1]"), "append_": (lambda: F.array_append(F.split("p_name", " "), "z"), "list_append(string_split(p_name, ' '), 'z')"),
    "prepend_": (lambda: F.array_prepend(F.split("p_name", " "), "a"), "list_prepend('a', string_split(p_name, ' '))"), "insert_": (lambda: F.array_insert(F.split("p_name", " "), 2, "m"), "list_concat(list_append(string_split(p_name, ' ')[1:1], 'm'), string_split(p_name, ' ')[2:])"),
    "remove_": (lambda: F.array_remove(F.split("p_name", " "), "red"), "list_filter(string_split(p_name, ' '), lambda x: x <> 'red')"), "compact_": (lambda: F.array_compact(F.array("p_name", L(None))), "[p_name]"),
    "repeat_": (lambda: F.array_repeat("p_brand", 2), "[p_brand, p_brand]"), "sort_": (lambda: F.sort_array(F.split("p_name", " "), False), "list_reverse_sort(string_split(p_name, ' '))"), "array_sort_": (lambda: F.array_sort(F.split("p_name", " ")), "list_sort(string_split(p_name, ' '))"),
    "overlap_": (lambda: F.arrays_overlap(_ints(), F.array(L(4), L(5))), f"list_has_any({_I}, [4, 5])"), "flatten_": (lambda: F.flatten(F.array(F.array("p_name"), F.array("p_type"))), "[p_name, p_type]"),
    "union_": (lambda: F.sort_array(F.array_union(F.array("p_name", "p_type"), F.array("p_type"))), "list_sort(list_distinct([p_name, p_type]))"), "except_": (lambda: F.array_except(F.array("p_name", "p_type"), F.array("p_type")), "[p_name]"),
    "intersect_": (lambda: F.array_intersect(F.array("p_name", "p_type"), F.array("p_type")), "[p_type]"), "distinct_": (lambda: F.array_distinct(F.array("p_name", "p_name")), "[p_name]"), "reverse_": (lambda: F.reverse(F.split("p_name", " ")), "list_reverse(string_split(p_name, ' '))"),
    "zip_": (lambda: F.transform(F.arrays_zip(F.array("p_name"), F.array("p_type")), lambda s: F.concat(s["0"], s["1"])), "[p_name || p_type]"), "shuffle_": (lambda: F.sort_array(F.shuffle(F.split("p_name", " "))), "list_sort(string_split(p_name, ' '))"),
})
family("higher_order_functions", "part", "p_partkey", {
    "transform_": (lambda: F.transform(_ints(), lambda v: (v * 2).cast("bigint")), f"list_transform({_I}, lambda x: x * 2)"), "filter_": (lambda: F.filter(F.split("p_name", " "), lambda s: s.startswith("r")), "list_filter(string_split(p_name, ' '), lambda s: starts_with(s, 'r'))"),
    "exists_": (lambda: F.exists(_ints(), lambda v: v > 4), f"length(list_filter({_I}, lambda x: x > 4)) > 0"), "forall_": (lambda: F.forall(_ints(), lambda v: v < 4), f"length(list_filter({_I}, lambda x: x >= 4)) = 0"),
    "aggregate_": (lambda: F.aggregate(_ints(), L(0).cast("bigint"), lambda acc, v: acc + v), f"CAST(list_sum({_I}) AS BIGINT)"), "reduce_": (lambda: F.reduce(_ints(), L(1).cast("bigint"), lambda acc, v: acc * v), f"CAST(list_product({_I}) AS BIGINT)"),
    "zip_with_": (lambda: F.zip_with(F.split("p_name", " "), F.split("p_name", " "), lambda a, c: F.concat(a, c)), "list_transform(string_split(p_name, ' '), lambda x: x || x)"),
})
family("map_functions", "part", "p_partkey", {
    "keys_": (lambda: F.map_keys(F.create_map(L("a"), "p_name", L("b"), "p_type")), "['a', 'b']"), "values_": (lambda: F.map_values(F.create_map(L("a"), "p_name", L("b"), "p_type")), "[p_name, p_type]"),
    "get_": (lambda: F.create_map(L("a"), "p_name", L("b"), "p_type")["b"], "p_type"), "has_": (lambda: F.map_contains_key(F.create_map(L("a"), "p_name"), "z"), "false"), "entries_": (lambda: F.transform(F.map_entries(F.create_map(L("a"), "p_name")), lambda e: F.concat(e.key, e.value)), "['a' || p_name]"),
    "concat_": (lambda: F.map_keys(F.map_concat(F.create_map(L("a"), "p_name"), F.create_map(L("b"), "p_name"))), "['a', 'b']"), "from_arrays_": (lambda: F.map_from_arrays(F.array(L("k")), F.array("p_name"))["k"], "p_name"),
    "from_entries_": (lambda: F.map_from_entries(F.array(F.struct(L("k"), "p_name")))["k"], "p_name"), "filter_": (lambda: F.map_keys(F.map_filter(F.create_map(L("a"), "p_name", L("b"), "p_type"), lambda k, v: k == "b")), "['b']"),
    "transform_keys_": (lambda: F.map_keys(F.transform_keys(F.create_map(L("a"), "p_name"), lambda k, v: F.upper(k))), "['A']"), "transform_values_": (lambda: F.map_values(F.transform_values(F.create_map(L("a"), "p_name"), lambda k, v: F.upper(v))), "[upper(p_name)]"),
    "zip_with_": (lambda: F.map_values(F.map_zip_with(F.create_map(L("a"), "p_name"), F.create_map(L("a"), "p_type"), lambda k, a, c: F.concat(a, c))), "[p_name || p_type]"), "str_to_map_": (lambda: F.str_to_map(F.concat(L("x:"), "p_type"))["x"], "p_type"),
    "struct_": (lambda: F.struct(C("p_name").alias("n"), C("p_size").alias("s"))["n"], "p_name"), "named_struct_": (lambda: F.named_struct(L("n"), "p_type")["n"], "p_type"), "with_field_": (lambda: F.struct(C("p_name").alias("n")).withField("m", C("p_brand"))["m"], "p_brand"),
})
family("json_functions", "events", "event_id", {
    "get_": (lambda: F.get_json_object("props", "$.k"), "json_extract_string(props, '$.k')"), "from_": (lambda: F.from_json("props", "k bigint")["k"], "CAST(json_extract(props, '$.k') AS BIGINT)"), "to_": (lambda: F.to_json(F.struct("user_id", "event_type")), "CAST(to_json({'user_id': user_id, 'event_type': event_type}) AS VARCHAR)"),
    "keys_": (lambda: F.json_object_keys("props"), "json_keys(props)"), "length_": (lambda: F.json_array_length(F.concat(L("["), "user_id", L(",1]"))), "CAST(2 AS INTEGER)"), "bad_": (lambda: F.from_json(L("{bad"), "k bigint")["k"], "CAST(NULL AS BIGINT)"),
    "csv_": (lambda: F.from_csv(F.concat_ws(",", "user_id", "event_type"), "a bigint, b string")["b"], "event_type"), "to_csv_": (lambda: F.to_csv(F.struct("user_id", "event_type")), "concat_ws(',', user_id, event_type)"),
})


@register("json_tuple_rows", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS z FROM events")
def json_tuple_rows(spark, d):
    return table(spark, d, "events").select("event_id", F.json_tuple("props", "k", "z").alias("k", "z"))


def _xml():
    return F.concat(L("<p><n>"), "p_size", L("</n><n>2</n></p>"))


unchecked("xml_functions", "part", "p_partkey", {
    "xpath_": lambda: F.xpath(_xml(), L("p/n/text()")), "boolean_": lambda: F.xpath_boolean(_xml(), L("p/n")), "double_": lambda: F.xpath_double(_xml(), L("sum(p/n)")), "float_": lambda: F.xpath_float(_xml(), L("sum(p/n)")), "int_": lambda: F.xpath_int(_xml(), L("p/n[1]")),
    "long_": lambda: F.xpath_long(_xml(), L("p/n[1]")), "short_": lambda: F.xpath_short(_xml(), L("p/n[2]")), "number_": lambda: F.xpath_number(_xml(), L("p/n[1]")), "string_": lambda: F.xpath_string(_xml(), L("p/n[2]")),
    "from_": lambda: F.from_xml(F.concat(L("<p><n>"), "p_size", L("</n></p>")), "n int")["n"], "to_": lambda: F.to_xml(F.struct("p_size")), "schema_": lambda: F.schema_of_xml(L("<p><n>1</n></p>")), "json_schema_": lambda: F.schema_of_json(L('{"a": 1}')), "csv_schema_": lambda: F.schema_of_csv(L("1,a")),
}, of="p_size")


@register("explode_rows", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode_rows(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@register("posexplode_rows", "SELECT p_partkey, CAST(generate_subscripts(string_split(p_name, ' '), 1) - 1 AS INTEGER) AS pos, unnest(string_split(p_name, ' ')) AS word FROM part")
def posexplode_rows(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


@register("explode_outer_rows", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type END AS word FROM part")
def explode_outer_rows(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode_outer(F.when(C("p_size") > 25, F.array("p_type"))).alias("word"))


@register("inline_rows", "SELECT p_partkey, p_name AS a, p_size AS b FROM part UNION ALL SELECT p_partkey, p_type, 0 FROM part")
def inline_rows(spark, d):
    rows = F.array(F.struct(C("p_name").alias("a"), C("p_size").alias("b")), F.struct(C("p_type").alias("a"), L(0).alias("b")))
    return table(spark, d, "part").select("p_partkey", F.inline(rows))


@register("stack_rows", "SELECT s_suppkey, 'nation' AS k, s_nationkey AS v FROM supplier UNION ALL SELECT s_suppkey, 'one', 1 FROM supplier")
def stack_rows(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.stack(L(2), L("nation"), C("s_nationkey"), L("one"), L(1)).alias("k", "v"))


@register("word_frequencies", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word")
def word_frequencies(spark, d):
    words = F.explode(F.regexp_extract_all(F.lower("text"), L("[a-z]+"), L(0))).alias("word")
    return table(spark, d, "documents").select(words).groupBy("word").agg(F.count(L(1)).alias("n"))


@register("embedding_norms", "SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM embeddings")
def embedding_norms(spark, d):
    square = F.aggregate("embedding", L(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(F.sqrt(square), 4).alias("norm"))
