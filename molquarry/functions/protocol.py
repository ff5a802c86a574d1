"""Parsing and writing of tool-calling turns as Column functions.

Equal to Python's ``re``, ``json`` and ``str`` methods on the cases in the
tests; the patterns carry the Java flags that this takes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import COMPUTE_TOOL, V1_PROPERTIES, tools

# Patterns of the two call formats, the final line and the token separators.
V1_CALL = r"(?s)TOOL_CALL:\s*(\{.*?\})"
NATIVE_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
FINAL_LINE = r"(?smUd)FINAL:\s*(.+?)\s*$"
SEPARATORS = r"(?U)[\s,;:=]+"

def strip(c: Column) -> Column:
    """Without blanks at both ends, Unicode ones too."""
    return F.regexp_replace(c, r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$", "")


def _matched(c: Column, pattern: str) -> Column:
    found = F.regexp_extract(c, pattern, 1)
    return F.when(found != "", found)


def _object(json: Column) -> Column:
    """A text that is one JSON object as a variant; null for anything else, text behind the object included.

    The decoder reads one value and stops.  Wrapped in brackets and in braces
    alike, a second value, or whatever else follows, fails one of the two.
    """

    def check(j: Column) -> Column:
        def one(listed: Column) -> Column:
            first = F.try_variant_get(listed, "$[0]", "variant")
            alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & F.try_parse_json(F.concat(F.lit('{"v":'), j, F.lit("}"))).isNotNull()
            return F.when(_is_object(first) & alone, first)

        return _let(F.try_parse_json(F.concat(F.lit("["), j, F.lit("]"))), one)

    return _let(json, check)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _argument(v: Column, key: str) -> Column:
    """An entry of an object as text: null and truth values as Python prints them; null where there is no entry."""
    path = f'$["{key}"]'
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = F.try_variant_get(v, path, "string")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it.

    Conditions hide common parts from the optimiser's own elimination; the
    variable of a lambda over a one-element array is a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_v1_call(turn: Column) -> Column:
    """``struct<smiles, prop>`` of the first call in a turn, or null.

    The braces end at the first closing one; ``smiles`` and ``property`` are
    needed; the property is stripped, lowered and must be a known one.
    """

    def body(fields: Column) -> Column:
        prop = F.lower(strip(_argument(fields, "property")))
        smiles = _argument(fields, "smiles")
        return F.when(smiles.isNotNull() & prop.isin(*V1_PROPERTIES), F.struct(smiles.alias("smiles"), prop.alias("prop")))

    # Most turns hold no call: a plain search for the marker comes before the pattern and the decoder.
    return F.when(turn.contains("TOOL_CALL:"), _let(_object(_matched(turn, V1_CALL)), body))


def parse_native_call(turn: Column, version: int = 3) -> Column:
    """``struct<tool, smiles, prop, name>`` of the first native call in a turn, or null.

    The call is one JSON object whose ``arguments`` are an object too; the tool
    and its arguments are those that ``catalog.tools`` declares.
    """

    def body(call: Column) -> Column:
        def inner(args: Column) -> Column:
            out = F.lit(None).cast("struct<tool:string,smiles:string,prop:string,name:string>")
            for tool, wants in tools(version).items():
                values = {k: _argument(args, k) if allowed is None else F.lower(strip(_argument(args, k))) for k, allowed in wants.items()}
                ok = F.try_variant_get(call, "$.name", "string") == tool
                for k, allowed in wants.items():
                    ok = ok & (values[k].isNotNull() if allowed is None else values[k].isin(*allowed))
                none = F.lit(None).cast("string")
                fields = [F.lit(tool).alias("tool")] + [values.get(k, none).alias(n) for k, n in (("smiles", "smiles"), ("property", "prop"), ("name", "name"))]
                out = F.when(ok, F.struct(*fields)).otherwise(out)
            return out

        arguments = F.try_variant_get(call, "$.arguments", "variant")
        return F.when(_is_object(arguments), _let(arguments, inner))

    return F.when(turn.contains("<tool_call>"), _let(_object(_matched(turn, NATIVE_CALL)), body))


def parse_final(turn: Column) -> Column:
    """What follows the final marker up to the end of its line, stripped; null without marker."""
    return strip(_matched(turn, FINAL_LINE))


def tokens(text: Column) -> Column:
    """Words between blanks, commas, semicolons, colons and equals signs."""
    return F.filter(F.split(text, SEPARATORS), lambda t: t != "")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def is_broken_call(turn: Column) -> Column:
    """A turn that opens a native call but holds none that can be read."""
    return turn.contains("<tool_call>") & parse_native_call(turn).isNull()


def json_string(c: Column) -> Column:
    """A text as a JSON string literal as Python's ``json.dumps`` writes it: all but printable ASCII is escaped."""
    quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    names = F.create_map(*[F.lit(x) for k, v in short.items() for x in (chr(k), v)])

    def escaped(ch: Column) -> Column:
        # UTF-16 units, as JSON escapes count characters beyond the basic plane as two.
        units = F.hex(F.encode(ch, "UTF-16BE"))
        code = F.concat(F.lit("\\u"), F.lower(F.substring(units, 1, 4)), F.when(F.length(units) > 4, F.concat(F.lit("\\u"), F.lower(F.substring(units, 5, 4)))).otherwise(""))
        return F.when(ch.rlike("^[ -~]$"), ch).otherwise(F.coalesce(F.try_element_at(names, ch), code))

    odd = quoted.rlike("[^ -~]")
    slow = F.array_join(F.transform(F.regexp_extract_all(quoted, F.lit(r"(?s)(.)"), 1), escaped), "")
    return F.concat(F.lit('"'), F.when(odd, slow).otherwise(quoted), F.lit('"'))


def compute_call_text(smiles: Column, prop: Column) -> Column:
    """A property call in the native format."""
    return F.concat(
        F.lit(f'<tool_call>{{"name": "{COMPUTE_TOOL}", "arguments": {{"smiles": '), json_string(smiles), F.lit(', "property": '),
        json_string(prop), F.lit("}}</tool_call>"),
    )


def v1_call_text(smiles: Column, prop: Column) -> Column:
    """A property call in the first format."""
    return F.concat(F.lit('TOOL_CALL: {"smiles": '), json_string(smiles), F.lit(', "property": '), json_string(prop), F.lit("}"))


def tool_result(value: Column, json_value: Column, message: str) -> Column:
    """Content of a tool message: ``{"result": value}``, or ``{"error": message}`` where there is no value."""
    return F.when(value.isNotNull(), F.concat(F.lit('{"result": '), json_value, F.lit("}"))).otherwise(F.lit(f'{{"error": "{message}"}}'))
