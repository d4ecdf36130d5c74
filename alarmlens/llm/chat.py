"""Chat formatting by Spark expressions: sort, merge neighbours of one role, concatenate; and the way back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings. Each begins with ``<|``, which escaped text never holds."""

    start: str = "<|im_start|>"
    turn: str = "<|turn|>"
    end: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    """Double each backslash, then part ``<`` from ``|`` by a single one."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One string per conversation: ``conv_id, formatted``.

    A block is ``start role \\n text end \\n``. Neighbours of one role share a block and are
    parted by the ``turn`` mark, so every row of the input can be told apart again. Order: turn (NULL
    first), then role and text, so ties and repeated rows have one result; all repeats stay. NULL
    roles and texts count as empty. NULL conversation ids form one conversation. Other columns are ignored.
    A conversation is one string in the output, so its rows meet in one task.
    """
    blank = F.lit("")
    row = F.struct(
        F.col("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_turns"))

    def piece(item, i):
        before = F.get("_turns", i - 1)["role"]
        opening = F.concat(F.lit(template.start), _escape_role(item["role"]), F.lit("\n"))
        closed = F.concat(F.lit(template.end + "\n"), opening)
        mark = F.when(i == 0, opening).when(before == item["role"], F.lit(template.turn)).otherwise(closed)
        return F.concat(mark, escape(item["text"]))

    whole = F.concat(F.array_join(F.transform("_turns", piece), ""), F.lit(template.end + "\n"))
    return gathered.select("conv_id", whole.alias("formatted"))


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns back from the strings: ``conv_id, formatted, turns array<struct<role, text>>``."""

    def mark(text):
        return text.replace("|", r"\|")

    def turns_of(block):
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(template.end) - 1)
        return F.transform(
            F.split(body, mark(template.turn)),
            lambda text: F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text")),
        )

    blocks = F.split("formatted", mark(template.start))
    blocks = F.slice(blocks, F.lit(2), F.size(blocks) - 1)
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"))


def loss_text(turns: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between the turns."""
    learned = F.filter(turns, lambda t: t["role"].isin(*template.learned))
    return F.array_join(F.transform(learned, lambda t: t["text"]), "")


def digests(read: DataFrame, template: Template = Template()) -> DataFrame:
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = loss_text(F.col("turns"), template)
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
