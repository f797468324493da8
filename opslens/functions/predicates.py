"""Column expressions over the shell syntax of logged predicates and updates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_STRING = f'"{_STRING_BODY}"'

# Documents of few levels, whose quotes all belong to strings, are read by one pattern; it is a short cut only.
# A string begins a token; a quote inside a token is part of a value.
_PLAIN = rf'[^{{}}"]++|(?<!\S){_STRING}|(?<=\S)"'
_FLAT = rf'(?:{_PLAIN})*+'
_SHALLOW = rf'\{{(?:{_PLAIN}|\{{(?:{_PLAIN}|\{{{_FLAT}\}})*+\}})*+\}}'
_PREDICATE = f"^({_SHALLOW})(?= |$)"
_UPDATE = rf"^{_SHALLOW} \S* ({_SHALLOW})(?= |$)"

# Deeper ones are read by a pattern of the token rule below, one group inside the other; what it does not match is scanned.
_DEPTH = 128
_WORD = r'(?!\{(?![^ ])|\},?(?![^ ])|")[^ ]*+'
_WORDS = r'"(?:[^"\n\r\x{85}\x{2028}\x{2029}]++|(?<=\\)"|"(?!,?(?![^ ])))*+",?'
_CLOSED = r',?(?![^ ])'


def _nested(depth: int) -> str:
    """Pattern of a document of at most so many levels."""
    inner = rf'\{{(?: (?:{_WORD}|{_WORDS}))*+ \}}'
    for _ in range(depth - 1):
        inner = rf'\{{(?: (?:{_WORD}|{_WORDS}|{inner}{_CLOSED}))*+ \}}'
    return inner


_DEEP = _nested(_DEPTH)
_DEEP_PREDICATE = f"^({_DEEP}){_CLOSED}"
_DEEP_UPDATE = rf'^{_DEEP}{_CLOSED} (?!")[^ ]*+ ({_DEEP}){_CLOSED}'

# A quoted string, or a bare key or value without the colon or comma after it.
_SCALAR = f'"({_STRING_BODY})"' + r'|(?<!\S)([^\s"{}\[\],]\S*?)(?=:?,?(?:\s|$))'
# A quoted string, or a bare value; bare keys end in a colon and are left alone.  White space is spelled out, because a class
# with \s inside makes the threads of a machine wait for each other.
_SPACE = r' \t\n\x0B\f\r'
_VALUE = _STRING + rf'|(?<![^{_SPACE}])[^{_SPACE}"{{}}\[\],](?:[^{_SPACE}]*?[^{_SPACE}:,])?(?=,?(?:[{_SPACE}]|$))'
# Strings without a blank are skipped; a quote that is left over opens one that has a blank.
_SPACED_STRING = r'^(?:[^"]++|"(?:[^"\\\s]|\\.)*+")*+"'


def _document_ends(tokens: Column, quotes: bool) -> Column:
    """(first, second): number of the last token of the document at the start, and of the one that begins two tokens on.

    A running depth over the brace tokens, without a limit on nesting.  With ``quotes`` the tokens of a string, which
    begins a token with a quote and ends one, do not count; a quote inside a token is part of a value.
    """
    none = F.lit(None).cast("int")
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), none.alias("first"), none.alias("second"))

    def step(acc: Column, token: Column) -> Column:
        opens = F.lit(quotes) & ~acc["quoted"] & token.startswith('"')
        ends = token.rlike(r'(?<!\\)",?$')
        closed = F.when(acc["quoted"], ends).otherwise(ends & (F.length(token) > 1) & (token != '",'))
        inside = (acc["quoted"] | opens) & ~closed
        counted = ~(acc["quoted"] | opens)
        in_first, in_second = acc["first"].isNull(), acc["second"].isNull() & (acc["i"] >= acc["first"] + 2)
        change = F.when(counted & (token == "{"), 1).when(counted & token.isin("}", "},"), -1).otherwise(0)
        depth = F.when(in_first | F.coalesce(in_second, F.lit(False)), acc["depth"] + change).otherwise(acc["depth"])
        empty = counted & (acc["depth"] == 0) & token.isin("{}", "{},")
        end = ((change == -1) & (depth == 0)) | empty
        return F.struct(
            (acc["i"] + 1).alias("i"), depth.alias("depth"), inside.alias("quoted"),
            F.when(in_first & end, acc["i"]).otherwise(acc["first"]).alias("first"),
            F.when(F.coalesce(in_second, F.lit(False)) & end, acc["i"]).otherwise(acc["second"]).alias("second"))

    return F.aggregate(tokens, state, step)


def _between(tokens: Column, start: Column, end: Column) -> Column:
    """The tokens of a document as text; NULL unless they begin with a brace."""
    text = F.regexp_replace(F.array_join(F.slice(tokens, start + 1, end - start + 1), " "), ",$", "")
    return F.when(end.isNotNull() & F.get(tokens, start).startswith("{"), text)


def _scanned(rest: Column, second: bool) -> Column:
    """The first or second document by the token rule; strings are respected where that gives a document."""
    def read(tokens: Column, quotes: bool) -> Column:
        ends = F.transform(F.array(_document_ends(tokens, quotes)), lambda e: _between(tokens, e["first"] + 2, e["second"]) if second else _between(tokens, F.lit(0), e["first"]))
        return F.get(ends, F.lit(0))

    # Without a quote there is no string to respect, and the first document begins the text.
    again = lambda tokens: F.when(rest.contains('"'), read(tokens, False))
    read_all = F.transform(F.array(F.split(rest, " ")), lambda t: F.coalesce(read(t, True), again(t)))
    text = F.get(read_all, F.lit(0))
    return text if second else F.when(rest.startswith("{"), text)


def _found(rest: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches, or NULL; a pattern is tried once."""
    found = [F.filter(F.array(F.regexp_extract(rest, pattern, 1)), lambda text: text != "") for pattern in patterns]
    return F.coalesce(*[F.get(text, F.lit(0)) for text in found])


def predicate_text(rest: Column) -> Column:
    """The document at the start of the text, or NULL."""
    return F.coalesce(_found(rest, _PREDICATE, _DEEP_PREDICATE), _scanned(rest, second=False))


def update_text(rest: Column) -> Column:
    """The document one word after the end of the first one, or NULL."""
    return F.coalesce(_found(rest, _UPDATE, _DEEP_UPDATE), _scanned(rest, second=True))


def has_spaced_string(text: Column) -> Column:
    return text.rlike(_SPACED_STRING)


def to_json_text(text: Column) -> Column:
    """Shell syntax as JSON: every scalar becomes a string, ``$`` becomes ``OP_``, ``_id`` ``ID``."""
    renamed = F.replace(text, F.lit("new Date"), F.lit("new-Date"))
    renamed = F.replace(renamed, F.lit("_id"), F.lit("ID"))
    renamed = F.replace(renamed, F.lit("$"), F.lit("OP_"))
    return F.regexp_replace(renamed, _SCALAR, '"$1$2"')


def plain_text(json_text: Column) -> Column:
    """The JSON text without its quotes."""
    return F.replace(json_text, F.lit('"'), F.lit(""))


def skeleton(text: Column) -> Column:
    """The text with every value replaced by ``#``: few distinct texts, same shape."""
    return F.regexp_replace(F.replace(text, F.lit("new Date"), F.lit("new-Date")), _VALUE, "#")
