"""Multi-party perspective rotation of dialogues.

Every participant (a speaker other than `system`) gets a rendering of the dialogue in which that speaker is the
assistant and the others are users with their names; the mask covers what the assistant says, with its end mark.

A rendering is a row for each turn: its text, where it starts in the whole rendering, and the masked characters. The
whole is the turns' texts one after another, so a dialogue of any length is never gathered in one row or task: starts are
running sums over ranges of the turns.

What is said can't forge a turn: in texts `<|` becomes `<\\|`, and a backslash behind `<` is doubled; in names backslashes
are doubled, and `|`, line feeds and carriage returns become `\\p`, `\\n` and `\\r`. Both can be undone.

Cases: rows without role are those of a participant without name, apart from one called `unknown`; a null text is empty,
null turns come first, rows without conv_id are a conversation of their own. Very long texts are rendered whole. Rows equal
in all four columns are rendered once. Several rows of one turn follow each other by role, then text. A dialogue of only
`system` has no participants and no rows. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import running_sum

SYSTEM = "system"


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text")).distinct()


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def safe_text(text: Column) -> Column:
    """The text without marks of turns."""
    return _replaced(text, ("<\\", "<\\\\"), ("<|", "<\\|"))


def safe_name(name: Column) -> Column:
    """The name without what could end it."""
    return _replaced(name, ("\\", "\\\\"), ("|", "\\p"), ("\n", "\\n"), ("\r", "\\r"))


def _header(own: Column) -> Column:
    name = F.concat(F.lit("<|user name="), safe_name(F.col("speaker")), F.lit("|>\n"))
    return F.when(F.col("speaker") == SYSTEM, "<|system|>\n").when(own, "<|assistant|>\n").when(F.col("speaker").isNull(), "<|user|>\n").otherwise(name)


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, rendered, char_start, mask_start, mask_end (null where nothing is masked)."""
    turns = _turns(conversations)
    people = turns.where(F.col("speaker").isNull() | (F.col("speaker") != SYSTEM)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    rows = turns.join(people, turns.conv_id.eqNullSafe(people["of"])).drop("of")
    rows = rows.withColumn("header", _header(F.col("speaker").eqNullSafe(F.col("perspective"))))
    rows = rows.withColumn("rendered", F.concat("header", safe_text(F.col("text")), F.lit("<|end|>\n"))).withColumn("size", F.length("rendered").cast("long"))
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("speaker"), F.asc("text")]
    rows = running_sum(rows, order, ["conv_id", "perspective"], ["size"])
    start, own = F.col("cum_size") - F.col("size"), F.col("speaker").eqNullSafe(F.col("perspective"))
    return rows.select(
        "conv_id", "perspective", "turn", "speaker", "rendered", start.alias("char_start"),
        F.when(own, start + F.length("header")).alias("mask_start"), F.when(own, F.col("cum_size") - 1).alias("mask_end"),
    )


ORACLE = r"""
    WITH t AS (SELECT DISTINCT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations),
    p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS DISTINCT FROM 'system'),
    r AS (
        SELECT t.conv_id, perspective, turn, speaker, text,
               CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker IS NOT DISTINCT FROM perspective THEN '<|assistant|>' WHEN speaker IS NULL THEN '<|user|>'
                    ELSE '<|user name=' || replace(replace(replace(replace(speaker, '\', '\\'), '|', '\p'), chr(10), '\n'), chr(13), '\r') || '|>' END || chr(10) AS header
        FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
    ), s AS (SELECT *, header || replace(replace(text, '<\', '<\\'), '<|', '<\|') || '<|end|>' || chr(10) AS rendered FROM r),
    o AS (
        SELECT *, CAST(coalesce(sum(length(rendered)) OVER (
            PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
        ), 0) AS BIGINT) AS char_start FROM s
    )
    SELECT conv_id, perspective, turn, speaker, rendered, char_start,
           CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN char_start + length(header) END AS mask_start,
           CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN char_start + length(rendered) - 1 END AS mask_end
    FROM o
"""
