"""Text functions on literals, Vietnamese ones included."""

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.functions.answers import normalise_answer


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, clean",
    [("a\r\nb\rc", "a\nb\nc"), ("  a \t b  \n\n\n c ", "a b\n\nc"), ("a b", "a b"), ("\n\n", ""), ("", ""), ("a\n \t\n\nb", "a\n\nb")],
)
def test_clean(spark, raw, clean):
    assert one(spark, raw, T.clean_text) == clean


@pytest.mark.parametrize(
    "text, found",
    [
        ("theo 17/2022/tt-bgtvt quy định", "17/2022/TT-BGTVT"),
        ("Quyết định 569/QĐ-TTg nêu", "569/QĐ-TTg"),
        ("12 - 2020 - ND-CP", "12/2020/ND-CP"),
        ("không có gì", None),
    ],
)
def test_identifier(spark, text, found):
    assert one(spark, text, T.legal_identifier) == found


def test_folds(spark):
    assert one(spark, "Điều  Khoản", T.fold) == "dieu khoan"
    assert one(spark, "Điều khoản 5.", T.search_terms) == ["đieu", "khoan", "5"]
    assert one(spark, "17/2022/TT-BGTVT QĐ", T.slug) == "17-2022-TT-BGTVT QD"
    assert one(spark, "50%_a\\", T.like_escaped) == "50\\%\\_a\\\\"
    assert one(spark, "Nghị định 1/2", T.name_key) == "nghidinh1-2"


def test_citations(spark):
    text = "Theo Điều 5 và Điều 7, khoản 2 điểm a của 12/2020/NĐ-CP, Điều 5"
    assert one(spark, text, lambda x: T.citations(x, "articles")) == ["5", "7"]
    assert one(spark, text, lambda x: T.citations(x, "documents")) == ["12/2020/NĐ-CP"]
    assert one(spark, text, lambda x: T.citations(x, "points")) == ["a"]


def windows_by_loop(words, size, overlap):
    out, buffer, emitted = [], [], False
    for w in words:
        buffer.append(w)
        if len(buffer) == size:
            out.append(" ".join(buffer))
            emitted, buffer = True, buffer[len(buffer) - overlap :] if overlap else []
    if buffer and (not emitted or len(buffer) > overlap):
        out.append(" ".join(buffer))
    return out


@pytest.mark.parametrize("n, size, overlap", [(0, 4, 1), (3, 4, 1), (4, 4, 1), (5, 4, 1), (8, 4, 1), (40, 8, 2), (10, 1, 0)])
def test_windows(spark, n, size, overlap):
    text = " ".join(f"w{i}" for i in range(n))
    got = one(spark, text, lambda x: T.windows(T.words(x), size, overlap))
    assert [w["text"] for w in got] == windows_by_loop(text.split(), size, overlap)


@pytest.mark.parametrize(
    "answer, normal",
    [
        ("Theo Điều 5 [1], người [2] phải nộp.", "Theo Điều 5, người phải nộp."),
        ("Dựa trên ngữ cảnh 1, người lao động được nghỉ.", "Người lao động được nghỉ."),
        ("mức phạt (Ngữ cảnh 2) là 5 triệu.", "Mức phạt là 5 triệu."),
        ("**Luật** (Document ID: 128691) quy định", "Luật quy định"),
        ("Theo Điều 8 (Nghi-dinh-01-2021-ND-CP-dang-ky-283247), công ty", "Theo Điều 8, công ty"),
        ("", ""),
    ],
)
def test_normalise_answer(spark, answer, normal):
    assert one(spark, answer, normalise_answer) == normal
