"""Model-based detection with a pluggable annotator.

Texts are chunked, an annotator reads chunks in Arrow batches, its pieces are widened to words and
merged. A failing annotator costs its document the model's findings, never the rules'."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.config import MODEL
from maskwright.functions.text import WHITE_SPACE, needs_model, trimmed
from maskwright.storage import write_table

# Chunk size and overlap, the share by which a chunk with too many tokens shrinks, how far a token may
# lie ahead, and what models' labels stand for (without B- or I-; others count for none).
CHUNK, OVERLAP, SHRINK, AHEAD = 1200, 80, 0.9, 40
PII_LABELS = {
    "first_name": "PERSON",
    "last_name": "PERSON",
    "company_name": "ORG",
    "city": "LOCATION",
    "county": "LOCATION",
    "state": "LOCATION",
    "country": "LOCATION",
    "coordinate": "LOCATION",
    "street_address": "ADDRESS",
    "email": "EMAIL",
    "phone_number": "PHONE",
    "fax_number": "PHONE",
    "ssn": "SSN",
    "credit_debit_card": "CREDIT_CARD",
    "ipv4": "IP_ADDRESS",
    "ipv6": "IP_ADDRESS",
    "url": "URL",
    "date": "DATE",
    "date_of_birth": "DATE",
    "date_time": "DATE",
    "time": "DATE",
    "postcode": "ZIP",
    "medical_record_number": "ID_NUMBER",
    "health_plan_beneficiary_number": "ID_NUMBER",
    "account_number": "ID_NUMBER",
    "bank_routing_number": "ID_NUMBER",
    "swift_bic": "ID_NUMBER",
    "customer_id": "ID_NUMBER",
    "employee_id": "ID_NUMBER",
    "certificate_license_number": "ID_NUMBER",
    "tax_id": "ID_NUMBER",
    "unique_id": "ID_NUMBER",
    "vehicle_identifier": "ID_NUMBER",
    "license_plate": "ID_NUMBER",
    "device_identifier": "ID_NUMBER",
    "biometric_identifier": "ID_NUMBER",
    "user_name": "ID_NUMBER",
    "password": "ID_NUMBER",
    "pin": "ID_NUMBER",
    "api_key": "ID_NUMBER",
    "cvv": "ID_NUMBER",
    "mac_address": "ID_NUMBER",
    "http_cookie": "ID_NUMBER",
    "age": "SENSITIVE",
    "gender": "SENSITIVE",
    "race_ethnicity": "SENSITIVE",
    "religious_belief": "SENSITIVE",
    "sexuality": "SENSITIVE",
    "political_view": "SENSITIVE",
    "blood_type": "SENSITIVE",
    "occupation": "SENSITIVE",
    "employment_status": "SENSITIVE",
    "education_level": "SENSITIVE",
    "language": "SENSITIVE",
}
NAME_LABELS = {"PER": "PERSON", "ORG": "ORG", "LOC": "LOCATION"}
# End of fixed values.

#: (chunk texts) to, for each, a list of (start, end, type, score).
Annotator = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]


def count_words(text: str) -> int:
    """The default token counter: words and single marks."""
    n, inside = 0, False
    for c in text:
        word = c.isalnum()
        n += (word and not inside) or (not word and not c.isspace())
        inside = word
    return n


def label_table(spark: SparkSession, labels: dict[str, str] = PII_LABELS) -> DataFrame:
    """label, type: a registry of what a model's labels stand for, each with its B- and I- forms."""
    rows = [(form + label, type_) for label, type_ in labels.items() for form in ("", "B-", "I-")]
    return spark.createDataFrame(rows, "label string, type string")


class _Breaks:
    """The places of a text where a chunk had better end: after each space and newline (the space of ". " included)."""

    def __init__(self, text: str):
        self.at, self.length = [m.end() for m in re.finditer("[ \n]", text)], len(text)

    def before(self, start: int, limit: int) -> int:
        """The last such place up to limit, if more than half of what lies between start and limit stands before its mark; else
        limit, as at the end of the text."""
        k = bisect_right(self.at, limit) - 1
        if limit < self.length and k >= 0 and 2 * (self.at[k] - 1 - start) > limit - start:
            return self.at[k]
        return limit


def chunk(text: str, most_tokens: int = 512, count: Callable[[str], int] = count_words) -> list[tuple[int, str]]:
    """(offset, text) pieces that cover the text: at most CHUNK characters and most_tokens tokens, each overlapping
    the one before by OVERLAP characters or a quarter of it. A piece of too many tokens shrinks in proportion, and by SHRINK,
    and is broken again; a single character of too many is an error."""
    breaks = _Breaks(text)

    def fitting(start: int) -> str:
        piece = text[start : breaks.before(start, min(len(text), start + CHUNK))]
        while (tokens := count(piece)) > most_tokens:
            if len(piece) == 1:
                raise ValueError("a character has more tokens than a model takes")
            fewer = int(len(piece) * most_tokens / tokens * SHRINK)
            piece = text[start : breaks.before(start, start + min(max(fewer, 1), len(piece) - 1))]
        return piece

    out: list[tuple[int, str]] = []
    start = 0
    while start < len(text):
        piece = fitting(start)
        out.append((start, piece))
        end = start + len(piece)
        start = end if end == len(text) else end - min(OVERLAP, len(piece) // 4)
    return out


def chunks(df: DataFrame, id_col: str = "doc_id", text: str = "text", most_tokens: int = 512, count: Callable[[str], int] = count_words) -> DataFrame:
    """id, chunk_no, offset, chunk of every text that has a letter or digit."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, o, c) for i, t in zip(b["id"], b["text"], strict=True) for k, (o, c) in enumerate(chunk(t, most_tokens, count))]
            yield pd.DataFrame(rows, columns=["id", "chunk_no", "offset", "chunk"])

    some = df.where(needs_model(F.col(text))).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return some.mapInPandas(run, f"id {kind}, chunk_no int, offset int, chunk string").withColumnRenamed("id", id_col)


def packed(samples: list[str], most: int = CHUNK) -> list[list[int]]:
    """Which samples go to a model in one call: in order, up to `most` characters with two between each; a longer one
    goes alone."""
    out, size = [], 0
    for k, s in enumerate(samples):
        if not out or size + len(s) + 2 > most:
            out.append([])
            size = 0
        out[-1].append(k)
        size += len(s) + 2
    return out


def annotate(
    df: DataFrame, load: Callable[[], Annotator], id_col: str = "doc_id", text: str = "text", most_tokens: int = 512, batch: int = 32
) -> tuple[DataFrame, DataFrame]:
    """(spans, states). load is called once a Python worker; the annotator gets up to `batch` chunks a call, and if a
    call fails its chunks are tried one by one, so that a bad text costs only itself. spans: id, start, end, type,
    text, source, score, ord; states: id, ml_state (done or failed), ml_error. The model's output is a written
    table, so that it runs once for both."""
    pieces = chunks(df, id_col, text, most_tokens)
    kind = df.schema[id_col].dataType.simpleString()
    columns = ["id", "start", "end", "type", "text", "score", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, error = None, ""
        try:
            model = load()
        except Exception as e:
            error = repr(e)

        def answers(texts: list[str]) -> list:
            try:
                if model is None:
                    raise RuntimeError(error)
                return model(texts)
            except Exception as e:
                return [str(e) or repr(e)] if len(texts) == 1 else [x for t in texts for x in answers([t])]

        for b in batches:
            rows = []
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                for i, offset, c, got in zip(part["id"], part["offset"], part["chunk"], answers(list(part["chunk"])), strict=True):
                    bad = isinstance(got, str)
                    rows.append((i, None, None, None, None, None, got if bad else None))
                    rows += [] if bad else [(i, int(s) + offset, int(e) + offset, t, c[int(s) : int(e)], float(p), None) for s, e, t, p in got]
            yield pd.DataFrame(rows, columns=columns).astype({"start": "Int64", "end": "Int64"})

    shape = f"id {kind}, start int, end int, type string, text string, score double, error string"
    out = write_table(pieces.select(F.col(id_col).alias("id"), "offset", "chunk").mapInPandas(run, shape), "annotated")
    states = out.groupBy(F.col("id").alias(id_col)).agg(F.max("error").alias("ml_error"))
    states = states.withColumn("ml_state", F.when(F.col("ml_error").isNull(), "done").otherwise("failed"))
    bad = states.where("ml_state = 'failed'").select(id_col)
    spans = out.where("start is not null").groupBy(F.col("id").alias(id_col), "start", "end", "type").agg(F.first("text").alias("text"), F.max("score").alias("score"))
    ord_ = (F.lit(MODEL << 40) + F.col("start")).cast("bigint").alias("ord")
    return spans.join(bad, id_col, "left_anti").select(id_col, "start", "end", "type", "text", F.lit("ml").alias("source"), "score", ord_), states


def annotate_samples(samples: DataFrame, load: Callable[[], Annotator], most: int = CHUNK) -> DataFrame:
    """A scan's findings: the columns of samples (context, value, ...) with start, end, type, score of each finding, placed
    in the value. Samples are read as "context: value", packed to `most` characters a call; findings are clipped to the
    value, and blank ones dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            heads = [f"{c}: " for c in b["context"]]
            values = list(b["value"])
            rows = []
            for group in packed([h + v for h, v in zip(heads, values, strict=True)], most):
                at, places = 0, []
                for k in group:
                    places.append(at + len(heads[k]))
                    at = places[-1] + len(values[k]) + 2
                for s, e, t, p in model(["".join(f"{heads[k]}{values[k]}\n\n" for k in group)])[0]:
                    for k, place in zip(group, places, strict=True):
                        lo, hi = max(s - place, 0), min(e - place, len(values[k]))
                        if lo < hi and values[k][lo:hi].strip():
                            rows.append((k, lo, hi, t, float(p)))
            found = pd.DataFrame(rows, columns=["k", "start", "end", "type", "score"])
            yield b.iloc[found["k"].astype(int)].reset_index(drop=True).assign(**{c: found[c] for c in ("start", "end", "type", "score")})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema.fields)
    return samples.mapInPandas(run, f"{fields}, start int, end int, type string, score double")


def dictionary_annotator(names: dict[str, str], score: float = 0.9) -> Annotator:
    """A deterministic annotator: whole words of a dictionary (word to type)."""
    import re

    def run(texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        return [[(m.start(), m.end(), names[m[0]], score) for m in re.finditer(r"\w+", t) if m[0] in names] for t in texts]

    return run


def type_scores(logits: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, token, type, score: softmax over a token's labels, summed by type (labels without a type
    count for none); the best type where it beats none. logits: doc_id, token, label, logit; labels: label, type."""
    w = Window.partitionBy("doc_id", "token")
    e = logits.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    by = e.join(labels, "label", "left").groupBy("doc_id", "token", "type").agg(F.sum("e").alias("e"))
    best = by.groupBy("doc_id", "token").agg(
        F.sum("e").alias("total"), F.coalesce(F.sum(F.when(F.col("type").isNull(), F.col("e"))), F.lit(0.0)).alias("none"),
        F.max(F.when(F.col("type").isNotNull(), F.struct("e", "type"))).alias("best"),
    )
    return best.where(F.col("best.e") > F.col("none")).select("doc_id", "token", F.col("best.type").alias("type"), (F.col("best.e") / F.col("total")).alias("score"))


def align_tokens(text: Column, tokens: Column) -> Column:
    """array<struct<start, end>>: where each piece ("##" and white space stripped, any case) lies, looking on from the one
    before; null if it is more than AHEAD characters away."""
    low = F.lower(text)

    def add(acc: Column, token: Column) -> Column:
        piece = F.lower(trimmed(F.regexp_replace(token, "^##", "")))
        at = F.call_function("locate", piece, low, acc["at"] + 1) - 1
        ok = (at >= 0) & (at - acc["at"] <= AHEAD) & (piece != "")
        end = at + F.length(piece)
        place = F.when(ok, F.struct(at.alias("start"), end.alias("end")))
        return F.struct(F.when(ok, end).otherwise(acc["at"]).alias("at"), F.array_append(acc["out"], place).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(tokens, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])


def widen(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end>: a piece grown over the letters and digits on both sides, then cut by the white space
    at its ends; null if nothing is left."""
    before = F.length(F.regexp_extract(text.substr(F.lit(1), start), r"[\p{L}\p{N}]*\z", 0))
    after = F.length(F.regexp_extract(text.substr(end + 1, F.length(text)), r"^[\p{L}\p{N}]*", 0))
    s, e = start - before, end + after
    grown = text.substr(s + 1, e - s)
    left = F.length(grown) - F.length(F.regexp_replace(grown, f"^[{WHITE_SPACE}]+", ""))
    right = F.length(grown) - F.length(F.regexp_replace(grown, rf"[{WHITE_SPACE}]+\z", ""))
    return F.when(s + left < e - right, F.struct((s + left).alias("start"), (e - right).alias("end")))
