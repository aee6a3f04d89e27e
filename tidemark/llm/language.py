"""Problem 3: the language of every text and of every stretch of a mixed text, with a confidence.

Method: a byte convolutional network in numpy. Bytes are embedded; filters of several widths slide over
them; each feature takes its maximum over a fixed-length window; a softmax layer gives the languages. It is
trained on labelled samples (at most ``MOST_SAMPLES``) and labelled texts (at most ``MOST_LABELLED``), both chosen by a hash,
and applied to batches of windows of ``BLOCKS`` blocks of ``STRIDE`` bytes, one window for each block. A text's blocks are
then cut into stretches by the cheapest path through the languages, a change of language costing ``SWITCH``. Labels of
texts may be wrong or stand on mixed texts: wrong ones scatter over the languages and don't decide against the right ones.

Training sums in double precision and rounds the weights after each step, so that machines whose arithmetic differs in
the last digits train the same network. A driver keeps the last networks by the hash of what they were trained on.

Scale: one pass without a shuffle; the network (some 100 KB) is the only broadcast. Texts are read whole.

Defined results: null and blank texts and texts without letters have no stretch; hashtags, digits and signs
are left out; characters that look alike are brought to one form first; the confidence of a stretch is the
mean probability of its language over its windows, in 0..1; a repeated row gives the same result; a label
that names no known language is missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.glyphs import by_table
from tidemark.llm.sampling import fixed_sample

#: Most labelled samples and most labelled texts used in training, those with the lowest hashes of each language or of all.
MOST_SAMPLES, MOST_LABELLED = 20_000, 12_000
STRIDE, BLOCKS = 8, 5
WIDTHS, FILTERS, EMBEDDED = (3, 4, 5), 40, 8
EPOCHS, BATCH, RATE, SEED = 4, 128, 0.006, 5
#: Windows in the first and in the second training, the same for any number of texts, and places to which weights are rounded.
FIRST_WINDOWS, MOST_WINDOWS, PLACES = 4_000, 60_000, 6
#: Networks that a driver keeps.
KEPT = 4
#: Cost of a change of language along a text, in log probability, and the least letters of a stretch of its own.
SWITCH, LEAST_LETTERS = 4.0, 20
#: A label's language stands if its mean probability is at least this part of the highest.
LABEL_WORTH = 0.5
#: Bytes that go through the network at once.
CHUNK_BYTES = 1 << 17

# How labels name these languages.
NAMES = {
    "en": "en eng english", "es": "es spa spanish español espanol castellano", "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch", "pt": "pt por portuguese português portugues", "it": "it ita italian italiano",
    "ru": "ru rus russian русский",
}
_CODES = {name: code for code, names in NAMES.items() for name in names.split()}
_NOISE = re.compile(r"#[^\s#]+|[^\w\s]|[\d_]+")


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label names, None if it names none: 'en-US', 'ENG', 'English', 'en_GB (auto)'."""
    if label is None:
        return None
    found = re.match(r"[^\W\d_]+", label.strip().lower())
    name = found.group() if found else ""
    return _CODES.get(name, name if len(name) == 2 and name not in ("na", "un") else None)


def letters(text: str | None) -> str:
    """What the network reads of a text."""
    return " ".join(_NOISE.sub(" ", by_table(text).lower()).split()) if text else ""


class ByteNet:
    """Embedding, filters of several widths, maximum over the window, softmax."""

    def __init__(self, langs: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.emb = rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        self.emb[0] = 0
        self.conv = [rng.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def features(self, flat: np.ndarray) -> list[np.ndarray]:
        """For each width, the filter outputs at each position of a flat byte array."""
        emb = np.concatenate([self.emb[flat], np.zeros((max(WIDTHS), EMBEDDED), np.float32)])
        n = len(flat)
        return [
            np.concatenate([emb[k : k + n] for k in range(w)], axis=1) @ c + b for w, c, b in zip(WIDTHS, self.conv, self.bias)
        ]

    def windows(self, flat: np.ndarray) -> np.ndarray:
        """Log probabilities for the window that begins at each block; ``flat`` is a whole number of blocks, and the
        bytes beyond the end are 0. Slices bound the memory, however long a text is."""
        blocks = len(flat) // STRIDE
        padded = np.concatenate([flat, np.zeros(BLOCKS * STRIDE, np.uint8)])
        step = CHUNK_BYTES // STRIDE
        return np.concatenate([self._slice(padded[at * STRIDE :], min(step, blocks - at)) for at in range(0, blocks, step)])

    def _slice(self, flat: np.ndarray, blocks: int) -> np.ndarray:
        """Log probabilities for the first ``blocks`` windows."""
        flat = flat[: (blocks + BLOCKS) * STRIDE]
        pooled = np.concatenate([f.reshape(-1, STRIDE, FILTERS).max(1) for f in self.features(flat)], axis=1)
        wide = pooled[:blocks]
        for k in range(1, BLOCKS):
            wide = np.maximum(wide, pooled[k : k + blocks])
        z = np.maximum(wide, 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteNet:
        """``x``: windows of bytes, ``y``: their languages. Adam on the cross-entropy; the embedding stays as drawn."""
        rng = np.random.default_rng(seed)
        size = x.shape[1]
        emb_table = self.emb.astype(np.float64)
        conv, bias = [c.astype(np.float64) for c in self.conv], [b.astype(np.float64) for b in self.bias]
        out, out_bias = self.out.astype(np.float64), self.out_bias.astype(np.float64)
        params = [*conv, *bias, out, out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                xb, yb = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
                n = len(xb)
                emb = np.concatenate([emb_table[xb], np.zeros((n, max(WIDTHS), EMBEDDED))], axis=1)
                cols, peaks, values = [], [], []
                for w, c, b in zip(WIDTHS, conv, bias):
                    col = np.concatenate([emb[:, k : k + size] for k in range(w)], axis=2)
                    got = (col.reshape(n * size, -1) @ c + b).reshape(n, size, FILTERS)
                    peak = got.argmax(1)
                    cols.append(col)
                    peaks.append(peak)
                    values.append(np.take_along_axis(got, peak[:, None, :], 1)[:, 0])
                pooled = np.concatenate(values, axis=1)
                kept = (rng.random(pooled.shape) > 0.3) / 0.7
                hidden = np.maximum(pooled, 0) * kept
                z = hidden @ out + out_bias
                z = np.exp(z - z.max(1, keepdims=True))
                dz = z / z.sum(1, keepdims=True)
                dz[np.arange(n), yb] -= 1
                dz /= n
                dh = (dz @ out.T) * kept * (pooled > 0)
                rows = np.arange(n)[:, None]
                convs, biases = [], []
                for k in range(len(WIDTHS)):
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    chosen = cols[k][rows, peaks[k]].transpose(1, 2, 0)  # filters, width x embedded, windows
                    convs.append((chosen @ d.T[:, :, None])[:, :, 0].T)
                    biases.append(d.sum(0))
                step += 1
                rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(params, [*convs, *biases, hidden.T @ dz, dz.sum(0)], first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * m / (np.sqrt(v) + 1e-8)
                    np.round(p, PLACES, out=p)
        self.conv, self.bias = [c.astype(np.float32) for c in conv], [b.astype(np.float32) for b in bias]
        self.out, self.out_bias = out.astype(np.float32), out_bias.astype(np.float32)
        return self

    def stretches(self, texts: list[str], labels: list[str | None] | None = None) -> list[list[tuple[str, float, int, int]]]:
        """For each text the (language, confidence, first byte, end byte) of its stretches, in order. A text of one
        language keeps the language of its label if that is nearly as likely (``LABEL_WORTH``)."""
        out: list[list[tuple[str, float, int, int]]] = []
        begin = 0
        while begin < len(texts):
            raw, end, size = [], begin, 0
            while end < len(texts) and (size == 0 or size < CHUNK_BYTES):
                raw.append(texts[end].encode("utf-8", "replace"))
                size += len(raw[-1])
                end += 1
            out += self._stretches(raw, labels[begin:end] if labels else [None] * len(raw))
            begin = end
        return out

    def _stretches(self, raw: list[bytes], labels: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        blocks = [-(-len(b) // STRIDE) for b in raw]
        # A text's last window would reach into the next text: blocks of zeros stand between them.
        gap = BLOCKS - 1
        flat = np.zeros((sum(blocks) + gap * len(raw)) * STRIDE, np.uint8)
        at, firsts = 0, []
        for b, n in zip(raw, blocks):
            firsts.append(at)
            flat[at * STRIDE : at * STRIDE + len(b)] = np.frombuffer(b, np.uint8)
            at += n + gap
        if not at:
            return [[] for _ in raw]
        logp = self.windows(flat)
        done: list[list[tuple[str, float, int, int]]] = []
        for first, n, b, label in zip(firsts, blocks, raw, labels):
            if not n:
                done.append([])
                continue
            own = logp[first : first + max(1, n - gap)]  # windows that lie inside the text
            found = self._path(own, b)
            if len(found) == 1 and label in self.langs and found[0][0] != label:
                mean = np.exp(own).mean(0)
                if mean[self.langs.index(label)] >= LABEL_WORTH * mean[self.langs.index(found[0][0])]:
                    found = [(label, float(mean[self.langs.index(label)]), 0, len(b))]
            done.append(found)
        return done

    def _path(self, own: np.ndarray, raw: bytes) -> list[tuple[str, float, int, int]]:
        top, size = own.argmax(1), len(raw)
        if (top == top[0]).all():
            return [(self.langs[top[0]], float(np.exp(own[:, top[0]]).mean()), 0, size)]
        score, back = own[0].copy(), np.zeros(own.shape, np.int32)
        for t in range(1, len(own)):
            best = int(score.argmax())
            moved = score[best] - SWITCH
            stay = score >= moved
            back[t] = np.where(stay, np.arange(len(score)), best)
            score = np.where(stay, score, moved) + own[t]
        path = [int(score.argmax())]
        for t in range(len(own) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        path.reverse()
        runs: list[list[int]] = []
        for t, s in enumerate(path):
            if runs and runs[-1][0] == s:
                runs[-1][2] = t + 1
            else:
                runs.append([s, t, t + 1])
        # A window begins at its block but tells of BLOCKS blocks: borders lie half a window later.
        half = (BLOCKS // 2) * STRIDE
        edges = [0, *(r[1] * STRIDE + half for r in runs[1:]), size]
        begins = np.cumsum(np.r_[0, (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80])  # characters before each byte
        # A stretch too short to stand alone goes to the longer of its neighbours, so that no text is left out.
        parts = [[s, float(np.exp(own[a:b, s]).sum()), b - a, x, min(y, size)] for (s, a, b), x, y in zip(runs, edges, edges[1:])]
        letters_in = lambda p: int(begins[p[4]] - begins[p[3]])
        while len(parts) > 1:
            k = min(range(len(parts)), key=lambda i: letters_in(parts[i]))
            same = next((i for i in range(len(parts) - 1) if parts[i][0] == parts[i + 1][0]), None)
            if same is not None:
                left, right = parts[same : same + 2]
                parts[same : same + 2] = [[left[0], left[1] + right[1], left[2] + right[2], left[3], right[4]]]
            elif letters_in(parts[k]) < LEAST_LETTERS:
                near = max((i for i in (k - 1, k + 1) if 0 <= i < len(parts)), key=lambda i: letters_in(parts[i]))
                parts[near][3], parts[near][4] = min(parts[near][3], parts[k][3]), max(parts[near][4], parts[k][4])
                del parts[k]
            else:
                break
        return [(self.langs[s], total / n, x, y) for s, total, n, x, y in parts]


def train(samples: list[tuple[str, str]], seed: int = SEED, windows: int = MOST_WINDOWS) -> ByteNet:
    """A network from (language, text) pairs: windows of the texts, joined in random order and cut anywhere, so that
    the network learns words and endings rather than whole sentences. Each language gives as many windows."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in samples})
    size = STRIDE * BLOCKS
    each = windows // max(1, len(langs))
    xs, ys = [], []
    for k, lang in enumerate(langs):
        texts = [t for t in (letters(s) for code, s in samples if code == lang) if t]
        texts = [texts[i] for i in rng.permutation(len(texts))]
        raw = np.frombuffer(" ".join(texts).encode() + bytes(size), np.uint8)
        if len(raw) <= size:
            continue
        begins = np.cumsum([0] + [len(t.encode()) + 1 for t in texts[:-1]])
        for at in rng.integers(0, len(raw) - size, each):
            window = np.zeros(size, np.uint8)
            keep = size if rng.random() < 0.7 else int(rng.integers(14, size))
            if keep < size:  # short texts are whole words from the start
                at = int(rng.choice(begins))
                keep = min(keep, len(raw) - at)
            window[:keep] = raw[at : at + keep]
            xs.append(window)
            ys.append(k)
    net = ByteNet(langs or ["und"], seed)
    return net.fit(np.array(xs), np.array(ys)) if xs else net


def train_twice(samples: list[tuple[str, str]], labelled: list[tuple[str, str]], seed: int = SEED) -> ByteNet:
    """Samples are few and clean, labelled texts many, some of them mixed. A small network of the samples tells which
    labelled texts are of one language; the second network is trained on the samples and on these, whatever language
    the first one takes them for: it knows too few words to overrule labels, most of which are right."""
    first = train(samples, seed, FIRST_WINDOWS)
    labelled = [(code, text) for code, text in labelled if code in first.langs]
    read = first.stretches([letters(t) for _, t in labelled])
    return train(samples + [x for x, got in zip(labelled, read) if len(got) == 1], seed)


_NETS: dict[bytes, ByteNet] = {}


def network(samples: list[tuple[str, str]], labelled: list[tuple[str, str]]) -> ByteNet:
    """``train_twice``, or what it gave for the same texts before."""
    key = xxhash.xxh3_128_digest(repr((samples, labelled)))
    if key not in _NETS:
        while len(_NETS) >= KEPT:
            del _NETS[next(iter(_NETS))]
        _NETS[key] = train_twice(samples, labelled)
    return _NETS[key]


def _segments(net):
    """Rows (record_id, label, text, least) to rows (record_id, segment_no, lang, confidence, first_word, last_word, label_right)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            clean = [letters(t) for t in pdf["text"]]
            words = [sum(not w.startswith("#") for w in by_table(t).split()) if t else 0 for t in pdf["text"]]
            codes = [label_code(x) for x in pdf["label"]]
            for i, code, text, n, least, got in zip(pdf["record_id"], codes, clean, words, pdf["least"], net.value.stretches(clean, codes)):
                if n < least or not got:
                    continue
                right = len(got) == 1 and code == got[0][0]
                raw = text.encode()
                for k, (lang, conf, a, b) in enumerate(got, 1):
                    rows.append((i, k, lang, conf, raw[:a].count(b" "), raw[:b].count(b" "), right))
            yield pd.DataFrame(rows, columns=["record_id", "segment_no", "lang", "confidence", "first_word", "last_word", "label_right"])

    return read


SEGMENTS = "record_id long, segment_no int, lang string, confidence double, first_word int, last_word int, label_right boolean"


def language_segments(texts: DataFrame, samples: DataFrame, id_col: str, text_col: str, label_col: str, min_words: int | Column,
                      labelled: DataFrame | None = None, labelled_rows: int = 0) -> DataFrame:
    """The stretches of every text of at least ``min_words`` words, hashtags aside; the number may differ by row.

    ``samples`` has lang, sample; ``labelled`` (record_id, label, text) may add up to ``MOST_LABELLED`` texts with labels
    of unknown worth, chosen by a hash of their ids; ``labelled_rows`` is about how many there are."""
    spark = texts.sparkSession
    rows = texts.select(F.col(id_col).cast("long").alias("record_id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"),
                        (min_words if isinstance(min_words, Column) else F.lit(min_words)).alias("least"))
    rows = rows.filter("record_id is not null and text is not null")
    clean = samples.select(F.col("lang"), F.col("sample")).filter("lang is not null and sample is not null")
    clean = sorted((r.lang, r["sample"]) for r in fixed_sample(clean, "sample", MOST_SAMPLES, clean.count()).collect())
    if not clean:
        return spark.createDataFrame([], SEGMENTS)
    more = []
    if labelled is not None:
        some = labelled.select("record_id", "label", "text").filter("label is not null and text is not null")
        some = fixed_sample(some, "record_id", MOST_LABELLED, labelled_rows).collect()
        more = [(code, r.text) for r in some if (code := label_code(r.label))]
    net = spark.sparkContext.broadcast(network(clean, more))
    return rows.mapInPandas(_segments(net), SEGMENTS)


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    posts = spark.read.parquet(f"{sf_dir}/processed_posts.parquet")
    posts = posts.select(F.col("post_id").alias("record_id"), F.col("declared_lang").alias("label"), F.col("cleaned_text").alias("text"))
    terms = spark.read.parquet(f"{sf_dir}/term_counts.parquet").filter("feature_type = 'phrase' and term_id is not null")
    latest = F.struct("loaded_at", "source_language", "term")
    terms = terms.groupBy("term_id").agg(F.max(latest).alias("row")).select(
        F.col("term_id").alias("record_id"), F.col("row.source_language").alias("label"), F.col("row.term").alias("text")
    )
    return posts, terms, spark.read.parquet(f"{sf_dir}/language_samples.parquet")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every post of five words and every phrase of four."""
    posts, terms, samples = _sources(spark, sf_dir)
    # One network reads both kinds; the count here is of words and hashtags, that of words alone follows.
    both = posts.withColumn("record_kind", F.lit("post")).unionByName(terms.withColumn("record_kind", F.lit("term")))
    rows = both.withColumn("key", F.col("record_id") * 2 + (F.col("record_kind") == "term").cast("long"))
    word_count = F.size(F.split(F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " ")), " "))
    rows = rows.filter((F.col("record_kind") == "post") & (word_count >= 5) | (F.col("record_kind") == "term") & (word_count >= 4))
    # Counts without a column come from the files' footers.
    about = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("processed_posts", "term_counts"))
    least = F.when(F.col("record_kind") == "post", 5).otherwise(4)
    found = language_segments(rows, samples, "key", "text", "label", least, labelled_rows=about, labelled=rows.drop("record_id").withColumnRenamed("key", "record_id"))
    kind = F.when(F.pmod("record_id", F.lit(2)) == 1, "term").otherwise("post")
    return found.select(
        kind.alias("record_kind"), F.floor(F.col("record_id") / 2).cast("long").alias("record_id"), "segment_no", "lang", "confidence",
        "first_word", "last_word", "label_right",
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_segments(spark, sf_dir).filter("not label_right").select("record_kind", "record_id", "segment_no", "lang")
