"""Chat formatting: records of many layouts become canonical turns, chosen by a fingerprint of their schema.

A record is a JSON object. Its nested field paths (array steps as ``[]``), sorted and hashed, are its fingerprint;
a table of declarative mappings tells for each fingerprint where prompts, instructions or messages stand. Where the whole
record has no mapping, paths that no mapping knows (ids, metadata, names) are left out of its fingerprint. Formatting
marks turns and escapes control strings inside texts, so that the formatted string can be read back exactly.

Roles stay as they are, but in the layout whose convention names them otherwise (``ROLES``). Nulls: a null role is
``user``, a null text is empty; an empty role is a role. Records that are no JSON object or of a layout without mapping
give null turns and their fingerprint, so that a mapping can be added. Ties of turn numbers are ordered by role, then
text; a null turn number comes first; repeated rows are turns each. A conversation without rows does not exist; an empty
table gives none. A text of any length is one turn of one row, never cut. Columns of ``df`` that are called
``fingerprint``, ``turns``, ``formatted`` or ``loss_mask`` are replaced; all others are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from streamloom.llm.common import column, map_arrow, plus, slices, table

#: Strings that may not stand in a text unescaped: this template's marks and those of common chat templates.
CONTROL = ["<|turn|>", "<|body|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
TURN, BODY, END = CONTROL[:3]
#: A place that begins a control string, whatever follows; its first character gets a backslash behind it.
STARTS = "(?=" + "|".join(re.sub(r"([\[\]|])", r"\\\1", s) for s in CONTROL) + ")(.)"
TURNS = ArrayType(StructType().add("role", "string").add("text", "string"))


#: Canonical roles of the names that the layout of ``from`` and ``value`` uses.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout(messages=None, role="role", text="text", fixed=(), roles=None) -> dict:
    """A mapping. ``messages``: path of a list with a role and a text field, whose roles ``roles`` renames; ``fixed``: (role, paths to join) in order."""
    return {"messages": messages, "role": role, "text": text, "fixed": [list(f) for f in fixed], "roles": roles or {}}


#: Field paths of a layout, which all stand in its records, and where its turns stand.
LAYOUTS = [
    (["messages[].role", "messages[].text"], layout("messages")),
    (["messages[].role", "messages[].content"], layout("messages", text="content")),
    (["conversations[].from", "conversations[].value"], layout("conversations", role="from", text="value", roles=ROLES)),
    (["dialog[].speaker", "dialog[].utterance"], layout("dialog", role="speaker", text="utterance")),
    (["prompt", "response"], layout(fixed=[("user", ["prompt"]), ("assistant", ["response"])])),
    (["prompt", "completion"], layout(fixed=[("user", ["prompt"]), ("assistant", ["completion"])])),
    (["question", "answer"], layout(fixed=[("user", ["question"]), ("assistant", ["answer"])])),
    (["instruction", "output"], layout(fixed=[("user", ["instruction"]), ("assistant", ["output"])])),
    (["input", "instruction", "output"], layout(fixed=[("user", ["instruction", "input"]), ("assistant", ["output"])])),
    (["system", "prompt", "response"], layout(fixed=[("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])])),
    (["data.input.text", "data.target.text"], layout(fixed=[("user", ["data.input.text"]), ("assistant", ["data.target.text"])])),
]


def paths(value, prefix: str = "") -> set[str]:
    """Nested field paths that end in a scalar; list items share a path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(paths(v, f"{prefix}[]") for v in value)) if value else set()
    return {prefix}


def fingerprint(names) -> str:
    return hashlib.sha256("\n".join(sorted(set(names))).encode()).hexdigest()[:16]


def mappings(layouts=LAYOUTS) -> dict[str, dict]:
    return {fingerprint(names): where for names, where in layouts}


def known_paths(where: dict) -> set[str]:
    """The field paths that a mapping reads."""
    return {f"{where['messages']}[].{where[k]}" for k in ("role", "text")} if where["messages"] else {p for _, names in where["fixed"] for p in names}


def matching(record: dict, known: dict[str, dict], read: set[str]) -> tuple[str, list[dict] | None]:
    """The fingerprint of the mapping that fits, or of the whole record, and the turns. ``read``: all paths that mappings know."""
    names = paths(record)
    whole = fingerprint(names)
    # What stands inside a known field is not ignored: the field is no text.
    told = {p for p in names if p in read or any(p.startswith((f"{k}.", f"{k}[")) for k in read)}
    for mark in (whole, fingerprint(told)):
        if mark in known:
            turns = turns_of(record, known[mark])
            return (whole, None) if turns is None else (mark, turns)
    empty = not told and any(where["messages"] and _get(record, where["messages"]) == [] for where in known.values())
    return whole, [] if empty else None


def _get(record, path: str):
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def turns_of(record: dict, where: dict) -> list[dict] | None:
    """The turns, or None where the list of messages holds anything but objects."""
    as_text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if where["messages"]:
        messages = _get(record, where["messages"])
        if not isinstance(messages, list) or not all(isinstance(m, dict) for m in messages):
            return None
        roles = ["user" if m.get(where["role"]) is None else as_text(m[where["role"]]) for m in messages]
        return [{"role": where["roles"].get(r, r), "text": as_text(m.get(where["text"]))} for r, m in zip(roles, messages, strict=True)]
    return [{"role": role, "text": "\n".join(t for t in (as_text(_get(record, p)) for p in names) if t)} for role, names in where["fixed"]]


def canonical(df: DataFrame, record_col: str = "record", known: dict[str, dict] | None = None) -> DataFrame:
    """``df`` without the record, with its layout's fingerprint and its turns (null where no mapping fits)."""
    known = known or mappings()
    read = set().union(*map(known_paths, known.values()))
    keep = [c for c in df.columns if c not in (record_col, "fingerprint", "turns")]
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, record_col):
            marks, turns = [], []
            for raw in column(b, record_col).to_pylist():
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                mark, told = matching(record, known, read) if isinstance(record, dict) else (None, None)
                marks.append(mark)
                turns.append(told)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), pa.array(marks, pa.string()), pa.array(turns, turn)], [*keep, "fingerprint", "turns"])

    rows = df.select(*keep, record_col)
    return map_arrow(rows, run, plus(df.select(*keep).schema, fingerprint="string", turns=TURNS))


def escape(text) -> F.Column:
    """Backslashes are doubled; every control string is broken by one behind its first character."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), STARTS, r"$1\\")


def unescape(text) -> F.Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns) -> F.Column:
    """One string: for each turn its mark, role, body mark, text and end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(END))), "")


def read_turns(text) -> F.Column:
    """The turns of a formatted string, with each text's span in it (code points): role, text, start, length."""
    pieces = F.filter(F.split(text, r"<\|end\|>"), lambda p: F.startswith(p, F.lit(TURN)))
    parts = F.transform(pieces, lambda p: F.struct(F.split(F.substring(p, len(TURN) + 1, 1 << 30), r"<\|body\|>").alias("p"), F.length(p).alias("n")))
    turns = F.transform(parts, lambda p: F.struct(p["p"][0].alias("role"), p["p"][1].alias("text"), p["n"].alias("n")))
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,text:string,start:int,length:int>>").alias("out"))
    step = lambda acc, t: F.struct(
        (acc["at"] + t["n"] + len(END)).alias("at"),
        F.concat(acc["out"], F.array(F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"), (acc["at"] + t["n"] - F.length(t["text"])).alias("start"), F.length(t["text"]).alias("length")))).alias("out"),
    )
    return F.aggregate(turns, seed, step, lambda acc: acc["out"])


def conversations_to_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation's rows by turn, as a JSON object of one of four layouts, chosen by a hash of the id.

    An exchange of one question and one answer may be a prompt with its response; the others are lists of messages.
    """
    message = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    named = lambda outer, role, text: F.to_json(F.struct(F.transform("m", lambda m: F.struct(m["role"].alias(role), m["text"].alias(text))).alias(outer)))
    first, second = F.get("m", F.lit(0)), F.get("m", F.lit(1))
    exchange = (F.size("m") == 2) & (first["role"] == "user") & (second["role"] == "assistant")
    pick = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    record = (
        F.when((pick == 0) & exchange, F.to_json(F.struct(first["text"].alias("prompt"), second["text"].alias("response"))))
        .when(pick <= 1, named("messages", "role", "text"))
        .when(pick == 2, named("messages", "role", "content"))
        .otherwise(named("dialog", "speaker", "utterance"))
    )
    return told.select("conv_id", record.alias("record"))


def format_chats(records: DataFrame) -> DataFrame:
    """Canonical turns, formatted: adds ``formatted`` and ``loss_mask`` (spans of assistant texts in it)."""
    out = canonical(records).withColumn("formatted", formatted(F.col("turns")))
    return out.withColumn("loss_mask", F.transform(F.filter(read_turns(F.col("formatted")), lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    out = format_chats(conversations_to_records(rows.unionByName(planted)))
    back = out.withColumn("back", read_turns(F.col("formatted")))
    masked = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _added(column: str) -> str:
    """SQL for the characters that escaping adds: one for each backslash and each control string."""
    counts = [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ["\\", *CONTROL]]
    return " + ".join(counts)


OP3_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    CAST(sum({len(TURN + BODY + END)} + length(role) + length(text) + {_added("role")} + {_added("text")}) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
