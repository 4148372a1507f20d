"""Tool calls in generated texts, as a table function: a row for each call, broken calls with the reason.

Use it with a lateral join, so that a table of texts becomes a table of calls:

    texts.lateralJoin(tool_calls(F.col("text").outer(), F.lit("hermes"), F.lit(None)))
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

from pyspark.sql import functions as F

# The marks of the three grammars.
CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
OPEN_CALL = re.compile(r"<tool_call>(.*?)</tool_call>|<tool_call>(.*?)$", re.DOTALL)
THOUGHT = re.compile(r"<\|start\|>assistant<\|channel\|>analysis<\|message\|>.*?<\|end\|>", re.DOTALL)
OPEN_THOUGHT = re.compile(r"<\|channel\|>analysis<\|message\|>(.*?)<\|end\|>", re.DOTALL)
CHANNEL_CALL = re.compile(r"<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>", re.DOTALL)
FUNCTION = re.compile(r"<function=(.*?)</function>|<function=(.*)$", re.DOTALL)
PARAMETER = re.compile(r"<parameter=(.*?)</parameter>|<parameter=(.*?)$", re.DOTALL)
# Names of types; others than these and objects are read as literals.
TEXT_TYPES, BOOLEAN_TYPES = ("string", "str", "text", "varchar", "char", "enum"), ("boolean", "bool", "binary")
WHOLE_TYPES, NUMBER_TYPES = ("int", "uint", "long", "short", "unsigned"), ("num", "float")

Call = tuple[str | None, str | None, str | None]


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def hermes(text: str, types: dict) -> tuple[str, list[Call]]:
    """JSON objects with name and arguments between marks."""
    calls: list[Call] = []
    for body in CALL.findall(text):
        try:
            found = json.loads(body)
            calls.append((found["name"], _json(found["arguments"]), None))
        except ValueError:
            calls.append((None, None, "not JSON"))
        except (KeyError, TypeError):
            calls.append((None, None, "no name or no arguments"))
    return CALL.sub("", text) if calls else text, calls


def channels(text: str, types: dict) -> tuple[str, list[Call]]:
    """Calls addressed to functions on a channel; thoughts are left out. Arguments stay as they are written."""
    text = OPEN_THOUGHT.sub("", THOUGHT.sub("", text))
    calls = [(name, arguments, None) for name, arguments in CHANNEL_CALL.findall(text)]
    return CHANNEL_CALL.sub("", text), calls


def typed(value: str, kind: str) -> object:
    """A parameter's text as its type; what doesn't fit stays text, a boolean is false then."""
    if value.lower() == "null":
        return None
    kind = kind.strip().lower()
    try:
        if kind in TEXT_TYPES:
            return value
        if kind.startswith(WHOLE_TYPES):
            return int(value)
        if kind.startswith(NUMBER_TYPES):
            number = float(value)
            return int(number) if number == int(number) else number
        if kind in BOOLEAN_TYPES:
            return value.lower() == "true"
        if kind == "object" or kind.startswith("dict"):
            try:
                return json.loads(value)
            except ValueError:
                pass
        return ast.literal_eval(value)
    except (ValueError, OverflowError, SyntaxError, MemoryError, RecursionError):
        return value


def elements(text: str, types: dict) -> tuple[str, list[Call]]:
    """Functions and parameters as elements, an open last one too; types of parameters come from the tools. One broken call leaves the text without calls."""
    if "<tool_call>" not in text:
        return text, []
    calls: list[Call] = []
    for body in (a or b for a, b in OPEN_CALL.findall(text)):
        for function in (a or b for a, b in FUNCTION.findall(body)):
            name, mark, rest = function.partition(">")
            if not mark:
                return text, [(None, None, "function without a name")]
            known, arguments = types.get(name, {}), {}
            for parameter in (a or b for a, b in PARAMETER.findall(rest)):
                key, mark, value = parameter.partition(">")
                if not mark:
                    return text, [(None, None, "parameter without a name")]
                value = value.removeprefix("\n").removesuffix("\n")
                arguments[key] = typed(value, known[key] if key in known else "string")
            calls.append((name, _json(arguments), None))
    return text[: text.index("<tool_call>")] if calls else text, calls


#: Readers by the name of their grammar.
GRAMMARS = {"hermes": hermes, "gpt-oss": channels, "qwen3_coder": elements}


@F.udtf(returnType="content string, place int, name string, arguments string, reason string")
class tool_calls:
    """content (the text without calls), place, name, arguments (JSON) and reason (why a call is broken); a text without calls gives one row without a place.

    Arguments: text, grammar, and for parameters' types a JSON object {function: {parameter: type}} or null. A null text gives no rows.
    """

    def eval(self, text: str, grammar: str, types: str) -> Iterator[tuple]:
        if text is None:
            return
        content, calls = GRAMMARS[grammar](text, json.loads(types) if types else {})
        for place, call in enumerate(calls):
            yield content, place, *call
        if not calls:
            yield content, None, None, None, None
