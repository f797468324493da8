"""Canonical shape of a predicate: keys in order, values left out.

Values are blanked first (``predicates.skeleton``), so reports see few distinct texts.  The shape is then built by one
column expression: a well-formed document is sorted by the engine as JSON, any other text is folded over its tokens with the
stack of open documents and lists as the state, so there is no limit on nesting and nothing leaves the engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslens.functions.predicates import skeleton

# Fixed values of the shape notation.
KEPT_KEYS = {"ID": ":_id", "COLLSCAN": "$COLLSCAN", "EOF": "$EOF"}
KEPT_TOP_KEYS = {"query": "$query", "orderby": "$orderby"}
FIELD = ":fieldname"
NO_DOCUMENT = ["COLLSCAN", "EOF"]

PARTS = "array<struct<name: string, text: string>>"
# An open list keeps the shapes of its items as one text, an open document those of its fields by name.
FRAME = f"struct<list: boolean, key: string, items: string, parts: {PARTS}>"
STATE = f"struct<stack: array<{FRAME}>, result: string, over: boolean>"

# A blanked document of whole words, with names that every sort orders alike.
_NAME = r'[^ "\\{}\[\],\x00-\x1f\x{10000}-\x{10ffff}]++(?<=[^:]:)'
_WELL_FORMED = rf'^(?=\{{)(?:(?:{_NAME}|\{{(?= )|[#}}\]],?|\{{\}},?|\[\],?|\[)(?: |$))*+$'
# As JSON: one field on each level, so there is nothing to sort.
_CHAIN = r'^(?:\{"[^"]++":)++(?:0|\{\}|\[(?:0(?:,0)*+)?\])\}++$'
# As JSON: so many levels at most.
LEVELS = 128
_SHALLOW = "^" + reduce(lambda inside, _: rf"(?:[^{{}}\[\]]++|[{{\[]{inside}[}}\]])*+", range(LEVELS), r"[^{}\[\]]*+") + "$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sort_name(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("_id"), F.lit("ID")), F.lit("$"), F.lit("OP_"))


def _one_of(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def _label(name: Column, top: Column) -> Column:
    operator = F.concat(F.lit(":$"), F.replace(name, F.lit("OP_"), F.lit("")))
    kept = F.coalesce(F.when(top, F.try_element_at(_one_of(KEPT_TOP_KEYS), name)), F.try_element_at(_one_of(KEPT_KEYS), name), F.lit(FIELD))
    return F.when((F.length(name) > 3) & name.startswith("OP_"), operator).otherwise(kept)


def _with_top(stack: Column, frame: Column) -> Column:
    return F.concat(F.slice(stack, 1, F.size(stack) - 1), F.array(frame))


def _added(stack: Column, result: Column, shape: Column, brackets: Column) -> Column:
    """The state after a value: a document, a list, or a scalar, whose ``shape`` is NULL."""
    def into(top: Column) -> Column:
        item = F.when(brackets == "<>", shape).otherwise("#")
        body = F.when((brackets == "<>") | ((brackets == "[]") & (top["key"] != "OP_in")), F.concat(F.substring(brackets, 1, 1), shape, F.substring(brackets, 2, 1))).otherwise("")
        named = F.concat(_label(top["key"], F.size(stack) == 1), body)
        # A key that comes again replaces the value it had.
        others = F.filter(top["parts"], lambda p: p["name"] != top["key"])
        part = F.array(F.struct(top["key"].alias("name"), named.alias("text"))).cast(PARTS)
        parts = F.when(top["list"] | top["key"].isNull(), top["parts"]).otherwise(F.concat(others, part))
        items = F.when(top["list"], F.concat(top["items"], item)).otherwise(top["items"])
        frame = F.struct(top["list"].alias("list"), top["key"].alias("key"), items.alias("items"), parts.alias("parts"))
        return F.struct(_with_top(stack, frame).alias("stack"), result.alias("result"), F.lit(False).alias("over"))

    alone = F.struct(stack.alias("stack"), F.coalesce(shape, F.lit("#")).alias("result"), F.lit(False).alias("over"))
    return F.when(F.size(stack) == 0, alone).otherwise(_let(F.get(stack, F.size(stack) - 1), into))


def _closed(acc: Column) -> Column:
    def into(top: Column) -> Column:
        fields = F.array_join(F.transform(F.array_sort(top["parts"]), lambda p: p["text"]), "")
        text = F.when(top["list"], top["items"]).otherwise(fields)
        below = F.slice(acc["stack"], 1, F.size(acc["stack"]) - 1)
        closed = F.struct(below.alias("stack"), text.alias("shape"), F.when(top["list"], "[]").otherwise("<>").alias("brackets"))
        return _let(closed, lambda c: _added(c["stack"], acc["result"], c["shape"], c["brackets"]))

    return _let(F.get(acc["stack"], F.size(acc["stack"]) - 1), into)


def _step(acc: Column, token: Column) -> Column:
    def read(bare: Column) -> Column:
        is_open = F.size(acc["stack"]) > 0
        frame = F.struct((bare == "[").alias("list"), F.lit(None).cast("string").alias("key"), F.lit("").alias("items"), F.array().cast(PARTS).alias("parts")).cast(FRAME)
        state = lambda stack, over=False: F.struct(stack.alias("stack"), acc["result"].alias("result"), F.lit(over).alias("over"))
        keyed = _let(F.get(acc["stack"], F.size(acc["stack"]) - 1), lambda top: _with_top(acc["stack"], F.struct(
            top["list"].alias("list"), _sort_name(F.substring(bare, F.lit(1), F.length(bare) - 1)).alias("key"), top["items"].alias("items"), top["parts"].alias("parts"))))
        empty = F.when(bare == "{}", "<>").otherwise("[]")
        return (F.when(acc["over"], acc)
                .when(bare.isin("{", "["), state(F.concat(acc["stack"], F.array(frame))))
                .when(bare.isin("}", "]"), F.when(is_open, _closed(acc)).otherwise(state(acc["stack"], over=True)))
                .when(bare.isin("{}", "[]"), _added(acc["stack"], acc["result"], F.lit(""), empty))
                .when(bare.endswith(":") & is_open, state(keyed))
                .otherwise(_added(acc["stack"], acc["result"], F.lit(None).cast("string"), F.lit(""))))

    return _let(F.rtrim(token, F.lit(",")), read)


def shape_of_skeleton(text: Column) -> Column:
    """Canonical shape of a blanked document; ``#`` for a text that is none."""
    return _let(text, lambda text: F.coalesce(_by_names(text), _folded(text)))


def _folded(text: Column) -> Column:
    """The shape by a fold over the tokens."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    start = F.struct(F.array().cast(f"array<{FRAME}>").alias("stack"), F.lit("#").alias("result"), F.lit(False).alias("over")).cast(STATE)
    return F.aggregate(tokens, start, _step, lambda acc: acc["result"])


def _by_names(text: Column) -> Column:
    """Shape of a well-formed blanked document by the engine's own sort of its keys; NULL where that cannot tell.

    As JSON the document is read into a variant, which keeps the keys of each object in order, and written again.  What
    stands beside a brace then says whether its document is a field or the item of a list.
    """
    named = F.replace(F.replace(text, F.lit("_id"), F.lit("ID")), F.lit("$"), F.lit("OP_"))
    quoted = F.regexp_replace(named, "([^ ]+):(?= )", '"$1":')
    json = F.replace(F.replace(quoted, F.lit(" #"), F.lit("0")), F.lit(" "), F.lit(""))

    def ordered(json: Column) -> Column:
        # A key that comes again, or text behind the document, does not come back at the same length.
        sorted_json = _let(F.try_parse_json(json).cast("string"), lambda found: F.when(F.octet_length(found) == F.octet_length(json), found))
        without = lambda *marks: F.length(reduce(lambda text, mark: F.replace(text, F.lit(mark), F.lit("")), marks, json))
        # The engine reads and writes JSON level by level on the stack of its thread.
        shallow = (F.length(json) - without("{", "[") <= LEVELS) | json.rlike(_SHALLOW)
        return _let(F.when(json.rlike(_CHAIN) & (without("{") == without("}")), json).when(shallow, sorted_json), shape)

    def shape(found: Column) -> Column:
        listed = F.when(found.contains('"OP_in":['), F.regexp_replace(found, r'"OP_in":\[[0,]*+\]', '"OP_in":0')).otherwise(found)
        return _let(listed, lambda fields: F.when(~fields.contains('"OP_in":[') & ~fields.rlike(r"[\[,]\["), _let(_top_names(fields), written)))

    def written(fields: Column) -> Column:
        out = F.regexp_replace(fields, r'\}(?=\}|,")', ">")
        for mark, sign in (("}", ""), (":{", ":<"), ("{", ""), ('":0', '":'), ("[0", "[#"), (",0", ",#"), (",", "")):
            out = F.replace(out, F.lit(mark), F.lit(sign))
        out = F.regexp_replace(out, '"OP_([^"]++)":', ":\\$$1")
        for name, label in (*KEPT_KEYS.items(), *zip(KEPT_TOP_KEYS.values(), KEPT_TOP_KEYS.values())):
            out = F.replace(out, F.lit(f'"{name}":'), F.lit(label))
        out = F.regexp_replace(out, '"[^"]++":', FIELD)
        return F.replace(out, F.lit("OP_"), F.lit(""))

    return F.when(text.rlike(_WELL_FORMED), _let(json, ordered))


def _top_names(fields: Column) -> Column:
    """Names that are kept in the outermost document only, as their label; NULL where they also occur further in."""
    def marked(keys: Column) -> Column:
        out, clear = fields, F.lit(True)
        for name, label in KEPT_TOP_KEYS.items():
            top = F.array_contains(keys, name)
            clear = clear & (~top | (F.regexp_count(fields, F.lit(f'"{name}":')) == 1))
            out = F.when(top, F.replace(out, F.lit(f'"{name}":'), F.lit(f'"{label}":'))).otherwise(out)
        return F.when(clear, out)

    kept = "|".join(KEPT_TOP_KEYS)
    return F.when(fields.rlike(f'"(?:{kept})":'), _let(F.json_object_keys(fields), marked)).otherwise(fields)


def shape_of(text: Column) -> Column:
    """Canonical shape of predicate text."""
    return shape_of_skeleton(skeleton(text))
