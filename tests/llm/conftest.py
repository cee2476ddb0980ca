import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
KINDS = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
#: Columns whose names the operators use themselves.
CLASHES = ["fp", "component_id", "score", "taken", "kind", "spans", "block", "row", "key", "h"]


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty, blank, short and very long texts, copies, near copies, repeated rows."""
    long = " ".join(f"word{k % 977} the of" for k in range(30_000))
    body = " ".join(f"alpha{k} beta{k}" for k in range(120))
    texts = [None, "", "  \n\t ", "one", "two words", body, body, body + " more", long, "x\n" * 300, "# * $ % & | < >" * 20, "é" * 150, "Apache License, Version 2.0 and the MIT License", "call +1 (555) 010-9999 or a@b.co", "\x00\x1f odd   \U0001f600"]
    rows = [(k, x, ("en", "fr", None)[k % 3], (None, "a", "b")[k % 3], None if x is None else len(x)) for k, x in enumerate(texts)]
    return [*rows, (5, body, "en", "a", len(body)), (None, body, None, None, None), (None, "lonely text without an id", "en", "a", 25), (None, None, None, None, None)]


def write(folder, rows, labels):
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    data = {name: pa.array(c, kind) for (name, kind), c in zip(KINDS, columns, strict=True)}
    data |= {name: pa.array(["z"] * len(rows), pa.string()) for name in CLASHES}
    pq.write_table(pa.table(data), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([x[1] for x in labels], pa.int32())}), f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd"), odd_documents(), [(1, 0), (2, None), (4, 1), (5, 0), (6, 1), (6, 0), (None, 1)])


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [])


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts(sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in sorted(t, key=lambda r: r["doc_id"])}
