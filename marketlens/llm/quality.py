"""Quality rules: a linear-chain conditional random field labels a text's lines as content or boilerplate; the share of content decides.

A line's features are cheap measures (length, symbols, capitals, repeats, ending) in a few bins; the field is trained on the small labelled
table below, and Viterbi decoding runs over batches of documents. A document is kept if at least half of the UTF-8 bytes of its lines with a word
are content, and the base rules of word count and repeated word windows do not fail it. Everything is a map over documents.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; of labels equally likely the first is taken; a share of exactly half
keeps; repeated rows give repeated rows; a null ``doc_id`` stays null; a very long text is judged whole by one task; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_text, mapped, raw
from .crf import LinearChain

SYMBOLS = b"#*$%&|<>"
#: Fixed by the contract.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
KEEP_SHARE = 0.5
CONTENT, BOILERPLATE = 0, 1

UPPER, LOWER, DIGITS, BANG = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"

#: Labelled lines, one document to a paragraph: C content, B boilerplate.
LABELLED = """
C The harbour was quiet in the morning, and the boats came in one after another with the night's catch.
C By noon the market had sold most of it. The rest went to the kitchens on the hill.
C Nobody spoke of the storm that had passed.

B Home | About | Products | Contact | Login
B Skip to main content
C The committee met on Tuesday to consider the report. It found that the bridge needs repair before winter.
C Members asked for a second estimate, and the engineer agreed to prepare one by the end of the month.
B Share this: Facebook | Twitter | Email
B Copyright 2020 All rights reserved.

B BUY NOW!! CHEAP!! OFFER!! LIMITED!! TIME!! ORDER!! TODAY!! FREE!! SHIPPING!! CLICK!! HERE!!
B BEST!! PRICE!! EVER!! DO!! NOT!! MISS!! THIS!! DEAL!! CALL!! US!! NOW!!

B win win win win win win win win win win win win win win win win
B prize prize prize prize prize prize prize prize prize prize prize prize
B cash cash cash cash cash cash cash cash cash cash

C Short note.
C It rained all day, so we stayed inside and read.
C Later.

B alpha | beta | gamma | delta | epsilon | zeta | eta | theta | iota | kappa | lambda | mu
B red | green | blue | yellow | black | white | purple | brown | grey | pink

B the*** cat%%% sat### on&&& the$$$ mat*** and%%% the### dog&&& ran$$$
B come### and$$$ see%%% our&&& new*** shop%%% with### many$$$ things&&&

B of%%% a*** few### who$$$ came&&& to*** this%%% page*** by$$$ way*** of%%% a### search*** most&&& will%%% go$$$ on*** to### the&&& next%%% one*** at$$$ once***

C The road was closed for a week while the crew cleared the fallen trees from it.
B So%%% we&&& took*** the### long$$$ way%%% round.*** It### had&&& been%%% raining$$$ for*** days,%%% and### the&&& fields*** lay$$$ under%%% water.*** Nobody### minded.&&& There%%% was$$$ time.***
B Then$$$ he%%% rose.*** She### did&&& too.%%% They$$$ left*** by### the&&& door%%% at*** the$$$ back.### It&&& was%%% late*** and$$$ the### street&&& was%%% dark.***
C In the end the crew went home.

C Der Fluss steigt im Frühling, wenn der Schnee in den Bergen schmilzt. Dann werden die Wiesen am Ufer nass.
C Die Leute im Dorf kennen das und warten.

C La maison est au bord de la route, et le jardin descend vers la rivière. On y voit souvent des hérons.
C En été, les enfants du village viennent y jouer.

C El tren sale a las ocho y llega antes del mediodía. Hay que cambiar en la capital.
C Los billetes se compran en la estación

C Released under the MIT License.
C We describe the method in section two and give results for 120 cases, of which 14 failed and 106 passed the test.
C Write to the office at info@example.org or call before noon.

B Menu
B Login
B Search
B <div> <span> <a> <li> <ul> <td> <tr> <th> <br> <hr>
B *** *** *** ### ### ### $$$ $$$ $$$

C Of the four houses only one is still lived in
C an old man keeps bees there and sells the honey by the road
C people say that he was a sailor

B 12 | 44 | 90 | 17 | 33 | 60 | 21 | 84 | 55 | 72
B click here click here click here click here click here click here click here
B NEXT PAGE >> PREVIOUS PAGE << TOP >> BOTTOM <<
"""

#: Feature numbers: always; bins of words, symbols a word, capitals, distinct words, bangs a word, digits; ending; seen before; a bar; title-like.
N_FEATURES = 26


def step(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[int]:
    n = len(words)
    letters_up = len(line) - len(line.translate(None, UPPER))
    letters = letters_up + len(line) - len(line.translate(None, LOWER))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    bangs = line.count(BANG)
    digits = len(line) - len(line.translate(None, DIGITS))
    distinct = len(set(words))
    out = [0, 1 + step(n, 3, 8, 20), 5 + step(symbols / n, 0.1, 0.4), 8 + (step(letters_up / letters, 0.3, 0.6) if letters else 3), 12 + (step(distinct / n, 0.35, 0.6) if n >= 6 else 3), 16 + step(bangs / n, 0.25), 18 + step(digits / max(1, len(line)), 0.1, 0.4)]
    last = words[-1][-1:]
    out.append(21 if last in b".?!:;,\"" else 22)
    if seen:
        out.append(23)
    if b"|" in line:
        out.append(24)
    return out


def document(text: bytes) -> tuple[list[bytes], list[bytes], list[list[int]], int]:
    """Words, lines with a word, those lines' features, lines that equal an earlier one."""
    words: list[bytes] = []
    lines: list[bytes] = []
    features: list[list[int]] = []
    seen: set[bytes] = set()
    repeats = 0
    for line in text.split(b"\n"):
        if own := line.split():
            words += own
            known = line in seen
            repeats += known
            seen.add(line)
            lines.append(line)
            features.append(line_features(line, own, known))
    return words, lines, features, repeats


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    # windows as pairs of numbered pairs, so that no product leaves 64 bits
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, counts = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


@lru_cache(maxsize=1)
def model() -> LinearChain:
    docs = [[x for x in part.split("\n") if x] for part in LABELLED.strip().split("\n\n")]
    features = [document("\n".join(x[2:] for x in doc).encode())[2] for doc in docs]
    return LinearChain(N_FEATURES, 2).fit(features, [[CONTENT if x[0] == "C" else BOILERPLATE for x in doc] for doc in docs])


def judge_batch(batch: pa.RecordBatch, chain: LinearChain) -> pa.RecordBatch:
    texts = raw(batch)
    parsed, own = [], []
    for text in texts:
        words, lines, features, repeats = document(text)
        # code points: bytes that don't continue a character
        points = len(text.decode("utf-8", "replace")) - (len(text) - sum(map(len, words)))
        parsed.append((len(words), points, len(text) - len(text.translate(None, SYMBOLS)), repeats, repeated_words(words)))
        own.append((np.fromiter(map(len, lines), np.int64, len(lines)), features))
    lengths = np.array([len(x) for x, _ in own])
    labels = chain.viterbi(chain.scores([f for _, x in own for f in x]), lengths)
    sizes = np.concatenate([x for x, _ in own]).astype(float) if own else np.zeros(0)
    doc = np.repeat(np.arange(len(own)), lengths)
    share = np.bincount(doc, sizes * (labels == CONTENT), len(own)) / np.maximum(1, np.bincount(doc, sizes, len(own)))
    columns = [np.array(c, np.int64) for c in zip(*parsed, strict=True)]
    failed = (columns[0] < LEAST_WORDS) | (100 * columns[4] > REPEAT_PERCENT * columns[0])
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns), pa.array(failed), pa.array(~failed & (share >= KEEP_SHARE)), pa.array(share)], names=names)


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, the base rules' verdict, the content share and whether the document is kept."""
    chain = model()
    return mapped(id_text(docs), lambda batch: judge_batch(batch, chain), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
