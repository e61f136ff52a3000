"""Language ID by fusing evidence in Bayes' rule.

Evidence of a row: its text's likelihood under each language's byte trigrams, the language its markup declares, the
suffix of its address, and a prior of its host. All but the trigrams come from grouped counts of the rows themselves, by
the language that the text alone suggests: the host's shares are smoothed towards its domain's, these towards the shares
of all rows, and a row's own vote is taken out of its host and domain.

The trigrams are fitted on a bounded sample of labelled rows (`sample` rows, those whose id has the least hashes; of rows
with one id and language that with the least text). A row without letters in its text gets the language the other evidence
suggests, no text_lang, and is not accepted; nor is one whose language has a probability below `accept`. A model that was
fitted on nothing judges nothing: it accepts all. Null text, declaration, address or host is evidence of nothing. Languages
that tie give the first in alphabetical order. Rows with equal or null ids are each judged on their own, of texts of any
length the whole; an empty table gives an empty result.

A host, a domain, a suffix or a declared language may have any share of all rows: counts of such are broadcast (see
common.attach), and rows that lack a host or a declaration meet no counts at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, attach, durable, slices

BITS = 15
#: Letters with A-Z as a-z; all else is a space.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_BLANK = (32 << 16 | 32 << 8 | 32) * 0x9E3779B1 % (1 << 32) >> (32 - BITS)


def trigrams(data: np.ndarray) -> np.ndarray:
    x = _FOLD[data]
    return (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)


def trigram_sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each row the sum of the table's rows over its trigrams; those without letters count nothing."""
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    for rows, starts, ends in slices(offsets, 2):
        if ends[-1] - starts[0] < 3:
            continue
        keys = trigrams(data[starts[0] : ends[-1]])
        lo, hi = starts - starts[0], np.maximum(ends - starts[0] - 2, starts - starts[0])
        if len(rows) == 1:
            out[rows[0]] += np.bincount(keys, minlength=1 << BITS) @ table
            continue
        total = np.zeros((len(keys) + 1, table.shape[1]))
        np.cumsum(table[keys], axis=0, out=total[1:])
        out[rows] += total[np.minimum(hi, len(keys))] - total[np.minimum(lo, len(keys))]
    return out


@dataclass(frozen=True)
class LanguageModel:
    """table: log probability of each hashed trigram, by language, with a last column that counts it (0 if blank)."""

    languages: tuple[str, ...]
    table: np.ndarray


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 3000) -> LanguageModel:
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id_"), F.lower(F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).alias("text"))
    # the ids are chosen without the texts and, being at most `sample`, broadcast: no text but the sample's is moved
    ids = rows.select("id_", F.xxhash64("id_").alias("h")).orderBy("h", "id_").limit(sample).select("id_").distinct()
    rows = rows.join(F.broadcast(ids), "id_").groupBy("id_", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = as_bytes(b.column(1))
            for k, lang in enumerate(b.column(0).to_pylist()):
                keys = trigrams(data[offsets[k] : offsets[k + 1]]) if offsets[k + 1] - offsets[k] > 2 else np.zeros(0, np.uint32)
                counts[lang] = counts.get(lang, np.zeros(1 << BITS, np.int64)) + np.bincount(keys, minlength=1 << BITS)
        for lang, n in counts.items():
            seen = np.flatnonzero(n) if n.any() else np.array([_BLANK])  # so that a language of empty texts is known
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen])], ["lang", "key", "n"])

    # summed before it comes to the driver: at most 2 ** BITS numbers for each language, however many tasks count
    summed = rows.mapInArrow(count, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    found: dict[str, np.ndarray] = {}
    names, keys, numbers = np.array(summed.column("lang").to_pylist(), object), summed.column("key").to_numpy(), summed.column("n").to_numpy()
    for lang in set(names):
        found[lang] = np.zeros(1 << BITS, np.int64)
        found[lang][keys[names == lang]] = numbers[names == lang]
    languages = tuple(sorted(found))
    table = np.zeros((1 << BITS, len(languages) + 1))
    table[:, -1] = 1
    for k, lang in enumerate(languages):
        counts = found[lang].astype(float)
        counts[_BLANK] = 0
        table[:, k] = np.log((counts + 0.1) / (counts + 0.1).sum())
    table[_BLANK] = 0
    return LanguageModel(languages, table)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def identify(
    rows: DataFrame,
    model: LanguageModel,
    id_col: str,
    text: Column,
    declared: Column | None = None,
    host: Column | None = None,
    address_suffix: bool = True,
    accept: float = 0.6,
    evidence: float = 150.0,
    host_weight: float = 20.0,
) -> DataFrame:
    """id, lang, probability, text_lang, letters (trigrams with letters), accepted of every row.

    evidence: however long a text is, it counts as at most so many trigrams. host_weight: rows that a host needs before
    its own shares weigh as much as its domain's, and a domain before the shares of all.
    """
    n = len(model.languages)
    table = model.table
    if not n:
        empty = F.lit(None).cast("string")
        return rows.select(F.col(id_col).alias("id"), empty.alias("lang"), F.lit(0.0).alias("probability"), empty.alias("text_lang"), F.lit(0).cast("long").alias("letters"), F.lit(True).alias("accepted"))

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = as_bytes(b.column(3))
            sums = trigram_sums(data, offsets, table)
            letters = np.rint(sums[:, -1])
            weight = evidence / (letters + evidence)
            ll = sums[:, :-1] * weight[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(letters.astype(np.int64)), pa.array(ll.argmax(axis=1).astype(np.int32)), *(pa.array(ll[:, k]) for k in range(n))], ["id", "declared", "host", "letters", "best", *(f"l{k}" for k in range(n))])

    none = F.lit(None).cast("string")
    known = declared if declared is not None else none
    tag = F.nullif(F.lower(F.regexp_extract(known, r"^\s*([A-Za-z]+)", 1)), F.lit(""))
    plain = rows.select(F.col(id_col).alias("id"), tag.alias("declared"), F.nullif(host if host is not None else none, F.lit("")).alias("host"), text.cast("string").alias("text"))
    fields = ", ".join(f"l{k} double" for k in range(n))
    kind = dict(plain.dtypes)["id"]
    scored = durable(plain.mapInArrow(likelihoods, f"id {kind}, declared string, host string, letters long, best int, {fields}"))

    votes = [F.sum(((F.col("best") == k) & (F.col("letters") > 0)).cast("double")).alias(f"v{k}") for k in range(n)]
    v = [f"v{k}" for k in range(n)]
    overall = scored.agg(*votes, F.count("*").alias("rows__")).first()
    rows_in_all, overall = max(1, overall["rows__"]), overall[:-1]
    total = sum(x or 0.0 for x in overall)
    share = [((x or 0.0) + 1) / (total + n) for x in overall]

    # one row a host: its votes, those of its domain, and of the suffix
    in_all = F.count("*").alias("rows__")
    hosts = scored.where("host is not null").groupBy("host").agg(*votes, in_all)
    hosts = durable(hosts.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1)))
    n_hosts = max(1, hosts.count())
    domains = durable(hosts.groupBy("domain").agg(*[F.sum(x).alias(f"d{x}") for x in v], F.count("*").alias("hosts__")))
    suffixes = durable(hosts.groupBy("suffix").agg(*[F.sum(x).alias(f"s{x}") for x in v], F.count("*").alias("hosts__")))
    hosts = durable(attach(attach(hosts, domains, "domain", n_hosts, "hosts__"), suffixes, "suffix", n_hosts, "hosts__").drop("domain"))
    tags = durable(scored.where("declared is not null").groupBy("declared").agg(*[x.alias(f"t{y}") for x, y in zip(votes, v, strict=True)], in_all))
    joined = attach(attach(scored, hosts, "host", rows_in_all), tags, "declared", rows_in_all)

    voted = F.col("letters") > 0
    own = [F.when(voted & (F.col("best") == k), 1.0).otherwise(0.0) for k in range(n)]
    zero = F.lit(0.0)
    known_domain = F.coalesce(F.col("suffix") != "", F.lit(False))
    up = [F.when(known_domain, F.greatest(F.col(f"dv{k}") - own[k], zero)).otherwise(zero) for k in range(n)]
    at = [F.greatest(F.coalesce(f"v{k}", zero) - own[k], zero) for k in range(n)]
    n_up, n_at = sum(up[1:], up[0]), sum(at[1:], at[0])
    logs = []
    for k in range(n):
        domain = (up[k] + host_weight * share[k]) / (n_up + host_weight)
        prior = (at[k] + host_weight * domain) / (n_at + host_weight)
        # P(evidence | language) over P(evidence), from the votes of all rows that show it
        seen = lambda c, k=k: F.when(c(0).isNotNull(), ((c(k) - own[k] + share[k]) / (sum((c(j) - own[j] for j in range(1, n)), c(0) - own[0]) + 1.0)) / share[k]).otherwise(1.0)
        says = F.greatest(seen(lambda j: F.col(f"tv{j}")), F.lit(1e-3))
        suffix = F.when(known_domain, F.greatest(seen(lambda j: F.col(f"sv{j}")), F.lit(1e-3))).otherwise(1.0) if address_suffix else F.lit(1.0)
        logs.append(F.col(f"l{k}") + F.log(prior) + F.log(says) + F.log(suffix))
    top = F.greatest(*logs) if n > 1 else logs[0]
    scaled = joined.select("*", *[x.alias(f"p{k}") for k, x in enumerate(logs)], top.alias("top"))
    weights = [F.exp(F.col(f"p{k}") - F.col("top")) for k in range(n)]
    probability = 1.0 / sum(weights[1:], weights[0])
    lang = F.coalesce(*[F.when(F.col(f"p{k}") == F.col("top"), F.lit(x)) for k, x in enumerate(model.languages)])
    names = F.when(voted, F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.col("best") + 1))
    return scaled.select("id", lang.alias("lang"), probability.alias("probability"), names.alias("text_lang"), "letters", (voted & (probability >= accept)).alias("accepted"))


