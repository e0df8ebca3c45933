"""From classified mentions to rows of the summary: dates by a ladder, names for typology codes, one row per find.

Mentions of one chunk meet; a chunk has a bounded length, so a group does too.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import certainty as ct
from ..functions import dates as dt
from ..functions import periods as pd
from ..functions import text as tx
from ..shared import materialise
from .records import overall_certainty

#: A name belongs to a typology code at most so many characters away.
REACH = 120
#: Names that say nothing about a find.
SAYS_NOTHING = ("pottery", "aardewerk", "ceramics", "ceramic", "keramiek", "vessel", "vessels", "")
DATED = "struct<start:int,end:int,method:string>"


def _rung(start: Column, end: Column, method: str) -> Column:
    found = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(method).alias("method"))
    return F.when(start.isNotNull() & end.isNotNull(), found)


def _narrowest(signals: Column, precision: str) -> Column:
    return dt.narrowest(F.transform(F.filter(signals, lambda s: s["precision"] == precision), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))


def best_dates(mentions: DataFrame, contexts: list[str], vocabulary: list[tuple[str, int, int]], out: str = "date") -> DataFrame:
    """``mentions`` with (start, end, method) by the first rung of a ladder that has a date.

    The rungs: the type's own range; an explicit year or range in one of the ``contexts``, in
    their order; of the first context with a century or a named period the narrower one; the
    section's phase; the range that a model read from the context; the assigned range.
    Generic forms stay undated. ``mentions`` has vocab_start, vocab_end, is_generic, the columns
    ``contexts`` and, as structs of start and end that may be null, section_date, model_date and
    assigned_date.
    """
    # mentions share sentences, so each different text is read once
    texts = mentions.select(F.explode(F.array(*contexts)).alias("_text")).where("_text is not null").distinct()
    worded = tx.modern_spelling(F.col("_text"))
    texts = texts.select("_text", F.coalesce(dt.date_signals(worded), F.array().cast(ArrayType(dt.SIGNAL))).alias("_s"), pd.named_period(worded, vocabulary).alias("_p"))
    high, medium, named = _narrowest(F.col("_s"), "high"), _narrowest(F.col("_s"), "medium"), F.col("_p")
    century, period = _rung(medium["start"], medium["end"], "text_century"), _rung(named["start"], named["end"], "chron_vocab")
    width = lambda r: F.struct(r["end"] - r["start"], r["start"], r["end"])
    # of equals the one that sorts first: widths, ends, then chron_vocab before text_century
    own = F.when(period.isNull(), century).when(century.isNull() | (width(period) <= width(century)), period).otherwise(century)
    known = materialise(texts.select("_text", _rung(high["start"], high["end"], "text_explicit").alias("_x"), own.alias("_o")), "dated_texts")
    read = mentions
    for i, name in enumerate(contexts):
        side = known.select(F.col("_text").alias(f"_t{i}"), F.col("_x").alias(f"_x{i}"), F.col("_o").alias(f"_o{i}"))
        read = read.join(side, F.col(name) == F.col(f"_t{i}"), "left")
    explicit, own = [F.col(f"_x{i}") for i in range(len(contexts))], [F.col(f"_o{i}") for i in range(len(contexts))]
    further = [_rung(F.col(f"{c}.start"), F.col(f"{c}.end"), m) for c, m in (("section_date", "section_phase"), ("model_date", "llm_context"), ("assigned_date", "typology"))]
    ladder = F.coalesce(_rung(F.col("vocab_start"), F.col("vocab_end"), "typology"), *explicit, *own, *further)
    read = read.withColumn(out, F.when(~F.col("is_generic"), ladder))
    return read.drop(*[f"_{k}{i}" for i in range(len(contexts)) for k in "txo"])


def pair_names(mentions: DataFrame, keys: list[str], most: int = REACH) -> DataFrame:
    """(keys, mention_id, name_id, taken): for each typology code of a group the nearest name that is still free.

    Codes choose in the order of ``position``; of equally near names the first is taken. A
    chosen name is free for no other code, and has no row of its own, if the code knows no name
    itself (``known`` is empty) or the name is a bare form. What is free depends on all earlier
    choices, so this is a function over the mentions of one group.
    """
    columns = [*keys, "mention_id", "kind", "position", "start_char", "end_char", "known", "is_form"]
    kinds = dict(mentions.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", mention_id {kinds['mention_id']}, name_id {kinds['mention_id']}, taken boolean"

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        """The pairs of whole groups, whose rows stand together in the order of their positions."""
        group = list(zip(*(table[k].to_pylist() for k in keys)))
        ids, kind, begin, stop, own, form = (table[c].to_pylist() for c in ("mention_id", "kind", "start_char", "end_char", "known", "is_form"))
        out, low = [], 0
        while low < len(group):
            high = low + 1
            while high < len(group) and group[high] == group[low]:
                high += 1
            free = [i for i in range(low, high) if kind[i] == "name"]
            for code in (i for i in range(low, high) if kind[i] == "typology"):
                gap, name = min(((max(begin[i] - stop[code], begin[code] - stop[i], 0), i) for i in free), default=(most + 1, None))
                if gap <= most:
                    taken = not own[code] or bool(form[name])
                    if taken:
                        free.remove(name)
                    out.append((code, name, taken))
            low = high
        columns = [pa.array([group[c][k] for c, _, _ in out], table.schema.field(name).type) for k, name in enumerate(keys)]
        of = table.schema.field("mention_id").type
        columns += [pa.array([ids[c] for c, _, _ in out], of), pa.array([ids[n] for _, n, _ in out], of), pa.array([t for _, _, t in out], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, [*keys, "mention_id", "name_id", "taken"])

    def choose(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            at, last = table.num_rows, [table[k][-1].as_py() for k in keys] if table.num_rows else None
            while at and [table[k][at - 1].as_py() for k in keys] == last:
                at -= 1
            held = table.slice(at)  # the last group may go on in the next batch
            if at:
                yield pairs_of(table.slice(0, at))
        if held is not None and held.num_rows:
            yield pairs_of(held)

    # many small groups share a batch: a call for each of them takes longer than what it does
    dealt = mentions.where(F.col("kind").isin("typology", "name")).select(*columns).repartition(*keys).sortWithinPartitions(*keys, "position")
    return dealt.mapInArrow(choose, schema)


def build_rows(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per find: typology codes with their name, names that no code took, and generic forms.

    ``mentions`` has ``keys``, mention_id, kind (typology, name or generic), position, start_char,
    end_char, known (the name that the vocabulary gives a code), label (the name of a mention),
    is_form, typology, date (of ``best_dates``), context_label and context_confidence. A date in
    a name's text replaces the code's; its period only fills a gap. A code whose name says
    nothing takes the vessel before ``of form`` or ``of type`` from its sentence, and a
    catalogue number that stands right before the code.
    """
    pairs = materialise(pair_names(mentions, keys), "pairs")  # read twice
    on = [*keys, "mention_id"]
    names = mentions.select(*keys, F.col("mention_id").alias("name_id"), F.col("label").alias("_label"), F.col("date").alias("_date"))
    paired = pairs.join(names, [*keys, "name_id"]).select(*on, "_label", "_date")
    taken = pairs.where("taken").select(*keys, F.col("name_id").alias("mention_id")).distinct()
    rows = mentions.join(taken, on, "left_anti").join(paired, on, "left")
    code, with_name = F.col("kind") == "typology", F.col("_label").isNotNull()
    pottery = F.when(code & with_name, F.coalesce(F.nullif("known", F.lit("")), "_label")).otherwise(F.col("label"))
    in_text = F.col("_date.method").isin("text_explicit", "text_century")
    date = F.when(code & with_name & (in_text | F.col("date").isNull()), F.col("_date")).otherwise(F.col("date"))
    rows = rows.withColumns({"pottery": pottery, "date": F.when(F.col("kind") != "generic", date), "typology": F.when(code, F.col("typology"))})
    sentence = F.coalesce("sentence", F.lit(""))
    vessel = F.lower(F.regexp_extract(sentence, r"(?i)\b(\p{L}+)\s+of\s+(?:the\s+)?(?:form|type)\b", 1))
    nothing = code & F.lower(F.trim("pottery")).isin(*SAYS_NOTHING) & (vessel != "")
    term = F.regexp_replace(F.trim(F.coalesce("term", F.lit(""))), r"\s+", " ")
    before = F.when(F.instr(sentence, term) > 1, F.left(sentence, F.instr(sentence, term) - 1))
    number = F.regexp_extract(F.coalesce(before, F.lit("")), r"([-\d/]*\d/\d[-\d/]*)\s*,\s*$", 1)
    catalogued = code & (term != "") & (number != "")
    rows = rows.withColumn("pottery", F.when(catalogued, number).when(nothing, vessel).otherwise(F.col("pottery")))
    level = F.when(code, 8).otherwise(6)
    presence = F.when(F.col("context_confidence") > 0, F.least(F.greatest(F.round(F.col("context_confidence") * 10).cast("int"), F.lit(0)), F.lit(10)))
    dated = ct.date_certainty(F.coalesce("date.method", F.lit("")), level, F.col("date").isNotNull())
    rows = rows.withColumns({"term_found": term, "pot_name_certainty_level": level, "pot_presence_certainty_level": presence, "dates_certainty_level": dated,
                             "start_date": F.col("date.start"), "end_date": F.col("date.end"), "date_method": F.col("date.method")})
    rows = rows.withColumn("overall_certainty_level", overall_certainty([F.col("pot_name_certainty_level"), F.col("pot_presence_certainty_level"), F.col("dates_certainty_level")]))
    return rows.drop("_label", "_date", "date")
