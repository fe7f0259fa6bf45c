"""The seam for models: calls with retries on the executors, and offline defaults that give the same result every time."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import collapse_space
from factloom.operators.facts import ISSUE_HANDLING
from factloom.sources.tables import stored

#: From a chunk's text to candidate facts (subject, predicate, value_text, unit, currency, period, scope, source_text, confidence).
Extractor = Callable[[str], list[dict]]

CANDIDATE = "document_id string, page_number int, chunk_id string, subject string, predicate string, value_text string, unit string, currency string, period string, scope string, source_text string, confidence double"
FACT = "subject string, predicate string, value_text string, unit string, source_text string, confidence double"
ISSUE = "issue_type string, message string, preview string"
#: What a model is told whose reply was no JSON.
AGAIN = 'That could not be read as JSON. Send the facts again as {"facts": [...]}, without any text around it.'
RETRYABLE = (408, 429, 500, 502, 503, 504)
_STATEMENT = re.compile(r"([A-Z][\w&' ]{1,60}?) (?:was|were|is|are|reached|totalled) ((?:[$€£₹] ?)?[-+]?\d[\d,]*(?:\.\d+)?)\s*(%|percent|crore|lakh|thousand|million|billion)?")


def rule_extractor(text: str) -> list[dict]:
    """Statements of the form "<subject> was <number> [unit]"."""
    found = []
    for m in _STATEMENT.finditer(text):
        subject, _, predicate = m[1].rpartition(" ")
        found.append({"subject": subject or m[1], "predicate": predicate, "value_text": m[2], "unit": m[3], "source_text": m[0], "confidence": 0.5})
    return found


def extract_facts(chunks: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    """Candidate facts of ``chunks`` (document_id, page_number, chunk_id, text, status); skipped chunks are not read."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CANDIDATE.split(", ")]
        for batch in batches:
            rows = [
                {"document_id": d, "page_number": p, "chunk_id": c, **fact}
                for d, p, c, text in zip(batch.document_id, batch.page_number, batch.chunk_id, batch.text, strict=True)
                for fact in extractor(text)
            ]
            found = pd.DataFrame([[row.get(c) for c in names] for row in rows], columns=names, dtype=object)
            yield found.astype({"page_number": "int32", "confidence": "float64"})

    pending = chunks.where("status <> 'skipped'").select(F.col("document_id").cast("string"), "page_number", "chunk_id", "text")
    return pending.mapInPandas(extract, CANDIDATE)


def repaired(model: Callable[[str], str], prompt: Callable[[str], str] = str) -> Callable[[str], tuple[list[dict], list[dict]]]:
    """Facts and issues of a text by a model that writes JSON; a reply that is no JSON is asked for again, once."""

    def facts_in(reply: str) -> list[dict]:
        found = json.loads(plain_json(reply))
        if not isinstance(found, dict) or not isinstance(found.get("facts"), list):
            raise ValueError("a reply must hold an array of facts")
        return found["facts"]

    def extract(text: str) -> tuple[list[dict], list[dict]]:
        first = model(prompt(text))
        try:
            return facts_in(first), []
        except json.JSONDecodeError as error:
            preview = re.sub(r"\s+", " ", first[:200])
            issue = {"issue_type": "malformed_json", "message": str(error), "preview": preview}
        return facts_in(model(f"{prompt(text)}\n\n{AGAIN}")), [issue]

    return extract


def plain_json(reply: str) -> str:
    """The JSON text of a reply, as ``functions.text.json_payload`` finds it."""
    spoken = re.sub(r"<think>.*?</think>", "", reply, flags=re.IGNORECASE | re.DOTALL).strip()
    bare = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", spoken, flags=re.IGNORECASE)).strip()
    if bare.startswith(("{", "[")):
        return bare
    inner = re.search(r"[\[{].*[\]}]", bare, re.DOTALL)
    return inner[0] if inner else bare


def extraction_round(chunks: DataFrame, extract: Callable[[str], tuple[list[dict], list[dict]]]) -> DataFrame:
    """One row for each chunk that is 'pending' or 'failed': document_id, page_number, chunk_id, status, facts, issues.

    ``extract`` gives a text's facts and issues. If it raises, the chunk is 'failed' with an issue that has the message's
    first line, and all others go on; else it is 'done'. So a further round sees failed chunks only.
    """
    names = [x.split()[0] for x in FACT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, p, c, text in zip(batch.document_id, batch.page_number, batch.chunk_id, batch.text, strict=True):
                try:
                    facts, issues = extract(text)
                    status = "done"
                except Exception as error:
                    message = str(error).split("\n")[0]
                    status, facts, issues = "failed", [], [{"issue_type": "chunk_failed", "message": message, "preview": None}]
                rows.append((d, p, c, status, [{x: f.get(x) for x in names} for f in facts], issues))
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "chunk_id", "status", "facts", "issues"])

    due = chunks.where(F.col("status").isin("pending", "failed")).select(F.col("document_id").cast("string"), "page_number", "chunk_id", "text")
    return due.mapInPandas(run, f"document_id string, page_number int, chunk_id string, status string, facts array<struct<{FACT}>>, issues array<struct<{ISSUE}>>")


def judged(listing: DataFrame, judge: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """Replies (document_id, request, reply) of a judge that is called once for each request of a ``listing``, and issues.

    ``listing`` has document_id, request, place and line; the lines of a request (at most a batch) go to the judge in order. If the
    call fails, or what comes back holds no verdicts, the reply is null and an ``adjudication_failed`` issue says why: its pairs
    stay apart, all others go on.
    """
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    asked = listing.groupBy("document_id", "request").agg(lines.alias("prompt"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, r, prompt in zip(batch.document_id, batch.request, batch.prompt, strict=True):
                try:
                    reply, message = judge(prompt), None
                    if not isinstance(json.loads(plain_json(reply)).get("verdicts"), list):
                        raise ValueError("a reply must hold an array of verdicts")
                except Exception as error:
                    reply, message = None, str(error).split("\n")[0]
                rows.append((d, r, reply, message))
            yield pd.DataFrame(rows, columns=["document_id", "request", "reply", "message"])

    schema = f"document_id {dict(listing.dtypes)['document_id']}, request int, reply string, message string"
    found = stored(asked.mapInPandas(ask, schema), "replies")  # so that no request is sent twice
    issues = found.where("message IS NOT NULL").select(
        "document_id", "request", F.lit("adjudication_failed").alias("issue_type"), "message", F.lit(ISSUE_HANDLING["adjudication_failed"]).alias("handling")
    )
    return found.select("document_id", "request", "reply"), issues


def after_round(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """``chunks`` with the status that a round left; its n_facts is 0 where the round had none, as before where it did not look."""
    now = found.select("chunk_id", F.col("status").alias("_status"), F.size("facts").alias("_facts"))
    before = F.col("n_facts") if "n_facts" in chunks.columns else F.lit(0)
    rows = chunks.join(now, "chunk_id", "left")
    return rows.withColumns({"status": F.coalesce("_status", "status"), "n_facts": F.coalesce("_facts", before)}).drop("_status", "_facts")


def document_runs(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, status and error of a run: it fails only if each of the chunks it tried failed."""
    tried = found.groupBy("document_id").agg(F.count("*").alias("tried"), F.count_if(F.col("status") == "failed").alias("failed"))
    rows = chunks.groupBy(F.col("document_id").cast("string").alias("document_id")).agg(F.count("*").alias("total")).join(tried, "document_id", "left")
    rows = rows.fillna(0, ["tried", "failed"])
    whole = (F.col("tried") > 0) & (F.col("failed") == F.col("tried"))
    error = F.when(whole, F.concat(F.lit("Fact extraction failed for all "), "tried", F.lit(" pending chunks"))).when(
        F.col("failed") > 0, F.concat(F.lit("Fact extraction skipped "), "failed", F.lit(" of "), "total", F.lit(" chunks"))
    )
    return rows.select("document_id", F.when(whole, "failed").otherwise("processed").alias("status"), error.alias("error"))


def hashed_vectors(texts: list[str | None], dimension: int = 64) -> np.ndarray:
    """A unit vector of each text's hashed character trigrams, for all texts at once; blank texts count as one space."""
    padded = [f" {x} " if x else "   " for x in ((t or "").strip().lower() for t in texts)]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in padded], dtype=np.int64)
    ends = np.cumsum(sizes)
    # A text has two trigrams fewer than characters; those that reach into the next text go to a slot that is cut off.
    key = code[:-2] * np.uint32(961) + code[1:-1] * np.uint32(31) + code[2:]
    mixed = key * np.uint32(2654435761)  # modulo 2 ** 32, as are the steps before
    slots = (mixed >> np.uint32(16)) % np.uint32(dimension) * np.uint32(2) + (mixed >> np.uint32(8) & np.uint32(1))
    width = 2 * dimension + 1
    at = np.repeat(np.arange(len(padded)) * width, sizes)[:-2] + slots
    across = np.concatenate([ends[:-1] - 2, ends[:-1] - 1])
    at[across] = 2 * dimension
    counts = np.bincount(at, minlength=len(padded) * width).reshape(-1, width)
    out = (counts[:, 1 : 2 * dimension : 2] - counts[:, 0 : 2 * dimension : 2]).astype(np.float64)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    out[length[:, 0] == 0, 0] = 1.0
    return out / np.where(length == 0, 1.0, length)


def hashed_vector(text: str | None, dimension: int = 64) -> list[float]:
    return hashed_vectors([text], dimension)[0].tolist()


def embed(text: Column, model: Callable[[list[str | None]], np.ndarray] = hashed_vectors) -> Column:
    """An ``array<double>`` column of each text's vector; the model sees tidy texts, some at a time."""

    @F.arrow_udf("array<double>")
    def vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            found = [np.asarray(model(part.slice(k, 64).to_pylist()), dtype=np.float64) for k in range(0, len(part), 64)]
            sizes = np.concatenate([[0], *[np.full(len(block), block.shape[1]) for block in found]])
            values = np.concatenate([np.zeros(0), *[block.ravel() for block in found]])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(values))

    return vectors(F.lower(collapse_space(F.coalesce(text, F.lit("")))))


def delay_seconds(attempt: int, message: str = "", base: float = 2.0, cap: float = 60.0) -> float:
    """What to wait before a retry: what the message asks for and half a second more, else doubling from ``base`` up to ``cap``."""
    asked = re.search(r"retry in ([\d.]+)s", message, re.IGNORECASE) or re.search(r'"retryDelay":\s*"([\d.]+)s"', message)
    return float(asked[1]) + 0.5 if asked else min(cap, base * 2**attempt)


def is_retryable(message: str) -> bool:
    found = re.search(r"\[(\d{3})\b|status:?\s*(\d{3})\b|\"status\":\s*(\d{3})\b", message, re.IGNORECASE)
    return bool(found) and int(next(x for x in found.groups() if x)) in RETRYABLE


def with_retries(call: Callable[[str], str], retries: int = 6, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``call`` with up to ``retries`` further tries after errors that may pass."""

    def tried(prompt: str) -> str:
        for attempt in range(retries + 1):
            try:
                return call(prompt)
            except Exception as error:
                if attempt == retries or not is_retryable(str(error)):
                    raise
                sleep(delay_seconds(attempt, str(error)))
        raise AssertionError

    return tried
