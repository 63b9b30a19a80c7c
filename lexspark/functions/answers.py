"""Normalising answers: removal of prompt scaffolding, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of scaffolding and of the punctuation that its removal leaves behind.
_CONTEXT = (
    r"(?:các\s+|những\s+)?ngữ\s*cảnh"
    r"(?:\s*\d+(?:\s*(?:,|và|-|đến)\s*(?:ngữ\s*cảnh\s*)?\d+)*)?"
    r"(?:\s+(?:được\s+)?(?:cung\s+cấp|nêu(?:\s+rõ)?|trích|đề\s+cập))?"
)
_PHRASE = rf"(?:(?:dựa\s+(?:trên|vào)|theo|tại|trong|từ|xem)\s+)?{_CONTEXT}"
STEPS: list[tuple[str, str, str]] = [
    ("U", r"\s*\[\d+\]", ""),
    ("iuU", r"\s*\(\s*(?:Document|Child)\s+ID\s*:?\s*[\w:]+\s*\)", ""),
    ("iuU", r"[,;]?\s*(?:Document|Child)\s+ID\s*:?\s*[\w:]+", ""),
    ("iuU", rf"\s*[(\[]\s*{_PHRASE}\s*[)\]]", ""),
    ("iuU", rf"[,;]?\s*{_PHRASE}\s*(?=[)\]])", ""),
    ("iuU", rf"(?:^|(?<=[.!?]))\s*(?:Đây\s+là|Điều\s+này|Thông\s+tin\s+này|Nội\s+dung\s+này|Chi\s+tiết\s+này)[^.!?:]*{_CONTEXT}[^.!?:]*[.!?:]", ""),
    ("iuU", rf"(?:^|(?<=[.!?:]))\s*{_CONTEXT}\s*(?:\([^)]*\))?\s*[:.]", ""),
    ("U", r"\s*\(\s*\w+(?:-\w+){3,}[^)]*\)", ""),
    ("iuU", r"\**\s*Văn bản\s*\d+\s*\**\s*:?\s*", ""),
    ("U", r"[*_`#]+", " "),
    ("Umd", r"^[ 	]*>+[ 	]+", ""),
    ("iuU", r"^\s*(?:Dựa\s+(?:trên|vào)|Theo|Căn\s+cứ|Trong)\s+(?:vào\s+)?ngữ\s+cảnh[^,.:;]*[,.:;]\s*", ""),
    ("iuU", rf"\s*{_PHRASE}", ""),
    ("iuUs", r"^\s*Câu\s+trả\s+lời\s+(?:cho\s+câu\s+hỏi\s*[\"“”].*?[\"“”]\s*)?là\s*:?\s*", ""),
    ("iuUs", r"^.{0,400}?(?:không\s+có\s+thông\s+tin|chưa\s+đủ\s+căn\s+cứ|không\s+tìm\s+thấy|không\s+nêu\s+rõ).{0,400}?Tuy\s+nhiên,\s*", ""),
    ("Ud", r"\s*\(\s*\w+(?:-\w+){2,}[^)]*$", ""),
    ("U", r"(\d+-\d{4}-[A-ZĐ]+(?:-[A-ZĐ]+)*)-[a-z0-9][A-Za-z0-9-]*", "$1"),
    ("iuUd", r"\s*(?:Vì\s+vậy|Do\s+đó|Tóm\s+lại)?[,\s]*(?:đây\s+là|câu\s+trả\s+lời)\s+(?:thông\s+tin\s+)?(?:chính\s+xác|đầy\s+đủ)[^.!?]*[.!?]\s*$", ""),
    ("U", r"[,;]\s*(?=[)\]])", ""),
    ("U", r"\s*[(\[]\s*[)\]]", ""),
    ("U", r"\s+([,.;:])", "$1"),
    ("U", r"([,.;:])(?:\s*[,;:])+", "$1"),
    ("U", r"\s+", " "),
    ("U", r"^ | $", ""),
    ("U", r"\s+([,.;:])", "$1"),
    ("U", r"^[\s,.;:)\]]+", ""),
]


def normalise_answer(answer: Column) -> Column:
    """An answer without citation marks, context references, file names, markdown and meta remarks; blanks collapsed."""
    out = answer
    for flags, pattern, new in STEPS:
        out = F.regexp_replace(out, f"(?{flags}){pattern}", new)
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))
