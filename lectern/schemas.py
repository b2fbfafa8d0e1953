"""Table shapes. row_ord is the order of rows in a source; nothing relies on physical order."""

from __future__ import annotations

from pyspark.sql import types as T

GROUND_TRUTH = "chapter int, verse int, greek_text string, face string, notes string, row_ord long"
INDIVIDUAL = "model string, agent_name string, chapter int, verse int, greek_text string, translation string, face_annotation string, notes string, score int, model_analysis string, row_ord long"
DEBATES = "chapter int, verse int, face_annotation string, greek_text string, translation string, debate string, closing_statements string, row_ord long"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_text, _int = T.StringType(), T.IntegerType()
TURN = _struct(role=_text, agent=_text, argument=_text, proposed_score=_int, violators=T.ArrayType(_text), intervened=T.BooleanType(), feedback=_text)
CLOSING = _struct(agent=_text, statement=_text, score=_int)
#: An individual and a debate entry in one; fields of the other type are null.
ENTRY = _struct(type=_text, model=_text, score=_int, reasoning=_text, debate_transcript=T.ArrayType(TURN), closing_statements=T.ArrayType(CLOSING))
SEGMENT = _struct(verse=_int, greek=_text, translation=_text, annotation=_text, notes=_text, analysis=T.ArrayType(ENTRY))
REPORT = _struct(book=_text, chapter=_int, category=_text, analysis=T.ArrayType(SEGMENT))


def _required(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable=False) for name, kind in fields.items()])


#: What models answer: an analysis, a review, a turn of a debate, a moderation.
ANSWERS = {
    "linguist_review": _required(score=_int, reasoning=_text),
    "critic_review": _required(accepted=T.BooleanType(), reasoning=_text),
    "linguist_turn": _required(agent_name=_text, argument=_text, proposed_score=_int),
    "moderator_turn": _required(intervene=T.BooleanType(), violators=T.ArrayType(_text, containsNull=False), feedback=_text),
}

_string, _integer, _objects = {"type": "string"}, {"type": "integer"}, lambda of: {"type": "array", "items": {"$ref": f"#/definitions/{of}"}}
# The fields of a report document, which of them must be there, and their bounds. Titles name the rules.
REPORT_SCHEMA = {
    "title": "L1",
    "type": "object",
    "properties": {"book": _string, "chapter": _integer, "category": _string, "analysis": _objects("segment")},
    "required": ["book", "chapter", "category", "analysis"],
    "definitions": {
        "segment": {
            "title": "L2",
            "type": "object",
            "properties": {"verse": _integer, "greek": _string, "translation": _string, "annotation": _string, "notes": _string, "analysis": _objects("entry")},
            "required": ["verse", "greek", "translation", "annotation", "analysis"],
        },
        "entry": {"oneOf": [{"$ref": "#/definitions/individual"}, {"$ref": "#/definitions/debate"}]},
        "individual": {
            "title": "L3",
            "type": "object",
            "properties": {"type": {"const": "individual"}, "model": _string, "score": {"type": "integer", "minimum": 1, "maximum": 10}, "reasoning": _string},
            "required": ["type", "model", "score", "reasoning"],
        },
        "debate": {
            "title": "L4",
            "type": "object",
            "properties": {"type": {"const": "debate"}, "score": _integer, "debate_transcript": _objects("turn"), "closing_statements": _objects("closing")},
            "required": ["type", "score", "debate_transcript", "closing_statements"],
        },
        "turn": {
            "title": "L5",
            "type": "object",
            "properties": {"role": {"type": "string", "enum": ["linguist", "moderator"]}, "agent": _string, "argument": _string, "proposed_score": {"type": ["integer", "null"]}, "intervened": {"type": "boolean"}, "feedback": _string, "violators": {"type": "array", "items": _string}},
            "required": ["role", "agent"],
        },
        "closing": {"title": "L6", "type": "object", "properties": {"agent": _string, "statement": _string, "score": _integer}, "required": ["agent", "statement", "score"]},
    },
}
