"""Questions made from sentences: WH questions where a pattern fits, else a gap to fill."""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bind, sentences, strip, title_first

# The verbs with their base forms, and the pattern of either side.
WH_VERBS = (("uses", "use"), ("retrieves", "retrieve"))
SIDE = r"[\p{L}\p{N}_\s-]{2,80}"
GAP = "____"
GAP_WORD = r"[A-Za-z0-9'-]+"


def wh_question(sentence: Column) -> Column:
    """Struct (question, answer) or null: "X uses Y" asks what X uses; the last verb of the sentence counts.

    A plain search for the verb goes first, as the patterns try every way to split a sentence that lacks it.
    """
    out = F.lit(None).cast("struct<question:string,answer:string>")
    for verb, base in reversed(WH_VERBS):
        rx = rf"(?i)^({SIDE})\s+{verb}\s+({SIDE})"
        asked = F.concat(F.lit("What does "), title_first(strip(F.regexp_extract(sentence, rx, 1))), F.lit(f" {base}?"))
        fits = F.contains(F.lower(sentence), F.lit(verb)) & sentence.rlike(rx)
        out = F.when(fits, F.struct(asked.alias("question"), strip(F.regexp_extract(sentence, rx, 2)).alias("answer"))).otherwise(out)
    return out


def gap_question(sentence: Column, draw: Column) -> Column:
    """Struct (question, answer) or null: a word of more than 3 characters, picked by ``draw``, is blanked where it first occurs."""
    words = F.regexp_extract_all(sentence, F.lit(f"{GAP_WORD[:-1]}{{4,}}"), F.lit(0))
    pick = lambda w: F.get(w, F.pmod(draw, F.greatest(F.size(w), F.lit(1))).cast("int"))

    def blank(answer: Column) -> Column:
        at = F.instr(sentence, answer)
        asked = F.concat(F.substring(sentence, F.lit(1), at - 1), F.lit(GAP), F.substring(sentence, at + F.length(answer), F.length(sentence)))
        return F.when(answer.isNotNull(), F.struct(asked.alias("question"), answer.alias("answer")))

    return bind(bind(words, pick), blank)


def questions(texts: DataFrame, per_text: int = 3, seed: int = 0) -> DataFrame:
    """(doc_id, rank, question, answers, type, context): up to ``per_text`` questions of each text.

    Choices are hashes of the seed, the text's id and the sentence's number, so they do not depend on how
    the data is dealt out.
    """
    split = texts.select("doc_id", F.posexplode(sentences("text")).alias("sent", "context"))
    # only sentences that are chosen are made into questions
    able = split.where(F.col("context").rlike(f"{GAP_WORD[:-1]}{{4,}}") | wh_question(F.col("context")).isNotNull())
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id", "sent", F.lit("order")), "sent")
    ranked = able.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_text)
    made = ranked.withColumn("wh", wh_question(F.col("context"))).withColumn("gap", gap_question(F.col("context"), F.xxhash64(F.lit(seed), "doc_id", "sent", F.lit("word"))))
    asked = made.withColumn("q", F.coalesce("wh", "gap"))
    return asked.select("doc_id", "rank", F.col("q.question").alias("question"), F.array("q.answer").alias("answers"), F.when(F.col("wh").isNotNull(), "wh").otherwise("cloze").alias("type"), "context")


def questions_in_stream_order(texts: DataFrame, per_text: int = 3, seed: int = 0) -> DataFrame:
    """As ``questions``, with one random stream over all texts in doc_id order.

    The stream makes this sequential: one task sees all texts, so it is for small inputs only.
    """
    wh = [(base, re.compile(rf"^([\w\s-]{{2,80}})\s+{verb}\s+([\w\s-]{{2,80}})", re.IGNORECASE)) for verb, base in WH_VERBS]

    def make(group: pd.DataFrame) -> pd.DataFrame:
        stream, rows = random.Random(seed), []
        for doc_id, text in group.sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False):
            found = []
            for s in filter(None, (p.strip() for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()))):
                hit = next(((b, m) for b, rx in wh if (m := rx.search(s))), None)
                if hit:
                    name = hit[1].group(1).strip()
                    found.append((f"What does {name[:1].upper()}{name[1:]} {hit[0]}?", hit[1].group(2).strip().rstrip("."), "wh", s))
                elif words := [w for w in re.findall(GAP_WORD, s) if len(w) > 3]:
                    answer = stream.choice(words)
                    found.append((s.replace(answer, GAP, 1), answer, "cloze", s))
            stream.shuffle(found)
            rows += [(doc_id, i + 1, q, [a], kind, s) for i, (q, a, kind, s) in enumerate(found[:per_text])]
        return pd.DataFrame(rows, columns=["doc_id", "rank", "question", "answers", "type", "context"])

    return texts.select("doc_id", "text", F.lit(0).alias("stream")).groupBy("stream").applyInPandas(make, "doc_id long, rank int, question string, answers array<string>, type string, context string")
