import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    line = "the quick brown fox jumps over one lazy dog while seven small birds watch from the old red barn near a quiet river bend"
    rows = [(i, f"{line} number {i} has its own words w{i} x{i} y{i} z{i} call +1 (555) 010-{1000 + i} or mail m{i}@host{i}.example.org", "a" if i % 3 else "b") for i in range(12)]
    rows += [(20, line + " " + line, "a"), (21, line.upper() + " " + line, "a"), (22, "Copy of " + line, "c"), (23, "Copy of " + line, "c"), (23, "Copy of " + line, "c")]
    rows += [(30, None, "a"), (31, "", None), (32, " \t\n", "c"), (33, "one", "c"), (None, "text without an id " + line, "a"), (35, "x" * 50_000, "d"), (36, "ab " * 20_000, "d")]
    rows += [(40, "what an idiot and moron", "a"), (41, "pay with 4111 1111 1111 1111 from 10.0.0.300 or 10.0.0.30 now", "a")]
    rows = [(*r, "en", len(r[1] or ""), "clash", 7, "clash") for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint, spans string, size int, toxic_score string")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")
