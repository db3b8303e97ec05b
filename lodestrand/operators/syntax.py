"""Chunks by syntax: the outermost declarations of a source file.

Python files are parsed; where that fails, declarations are found by indentation. For languages with
braces, comments and strings are blanked, declarations are matched where a statement may begin, and
their ends are found by matching brackets. What lies within a chunk is not looked at again. The text
is the declaration's own: it begins at its column, without indentation or comments before it.

A file whose language has a splitter but which holds no declaration has no chunks.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.config import SPLITTABLE_NODES
from lodestrand.functions import ids
from lodestrand.functions import text as X
from lodestrand.operators.chunking import COLUMNS
from lodestrand.shipping import ship

Span = tuple[int, int]


def python_spans(source: str) -> list[Span]:
    """(begin, end) of the outermost functions and classes, decorators included."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # MemoryError: what the parser raises when its stack overflows
        return _indented_spans(source)
    # The parser's line ends: a lone "\r" is one, too.
    ends = [m.end() for m in re.finditer(r"\r\n?|\n", source)]
    starts = [0, *ends, len(source)]

    def place(line: int, column: int) -> int:
        row = source[starts[line - 1] : starts[line]] if line < len(starts) else ""
        return starts[line - 1] + len(row.encode("utf-8", "surrogatepass")[:column].decode("utf-8", "ignore"))

    found: list[Span] = []
    # A stack, as trees may be deeper than Python's calls.
    left: list[ast.AST] = [tree]
    while left:
        for child in ast.iter_child_nodes(left.pop()):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                begin = place(child.lineno, child.col_offset)
                if child.decorator_list:
                    first = child.decorator_list[0]
                    begin = source.rfind("@", 0, place(first.lineno, first.col_offset) + 1)
                found.append((begin, place(child.end_lineno, child.end_col_offset)))
            else:
                left.append(child)
    return sorted(found)


_PY_HEAD = re.compile(r"^([ \t]*)(?:@|(?:async[ \t]+)?def\b|class\b)")


def _indented_spans(source: str) -> list[Span]:
    """Declarations of a text that does not parse: a head, and the deeper lines that follow."""
    rows = source.split("\n")
    starts = [0]
    for row in rows:
        starts.append(starts[-1] + len(row) + 1)
    found, k = [], 0
    while k < len(rows):
        head = _PY_HEAD.match(rows[k])
        if not head:
            k += 1
            continue
        first, depth, last = k, len(head[1].expandtabs()), k
        inside = not rows[k].lstrip().startswith("@")
        k += 1
        while k < len(rows):
            text = rows[k].strip()
            level = len(rows[k].expandtabs()) - len(rows[k].expandtabs().lstrip())
            if text and level <= depth:
                if inside or not _PY_HEAD.match(rows[k]):
                    break
                inside = not text.startswith("@")
            if text:
                last = k
            k += 1
        found.append((starts[first] + len(head[1]), starts[last] + len(rows[last].rstrip())))
    return found


_LINE_COMMENT = {"php": r"//[^\n]*|\#[^\n\[][^\n]*"}
_STRINGS = {
    "javascript": r"`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'",
    "typescript": r"`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'",
    "tsx": r"`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'",
    "rust": r"r(\#*)\"[\s\S]*?\"\1|'(?:\\[^\n]{1,8}?|[^'\\\n])'",
    "go": r"`[^`]*`|'(?:\\.|[^'\\\n])+'",
    "java": r"\"\"\"[\s\S]*?\"\"\"|'(?:\\.|[^'\\\n])+'",
    "scala": r"\"\"\"[\s\S]*?\"\"\"|'(?:\\.|[^'\\\n])'",
    "swift": r"\"\"\"[\s\S]*?\"\"\"",
    "csharp": r"@\"(?:[^\"]|\"\")*\"|'(?:\\.|[^'\\\n])+'",
    "php": r"'(?:\\.|[^'\\])*'",
    "c": r"'(?:\\.|[^'\\\n])+'",
    "cpp": r"R\"([^()\\\s]{0,16})\([\s\S]*?\)\1\"|'(?:\\.|[^'\\\n])+'",
}


def blanked(source: str, language: str) -> str:
    """The source with the characters of comments and strings replaced by spaces; line ends stay."""
    comment = _LINE_COMMENT.get(language, r"//[^\n]*")
    pattern = re.compile(rf"{_STRINGS.get(language, '')}{'|' if language in _STRINGS else ''}/\*[\s\S]*?(?:\*/|\Z)|{comment}|\"(?:\\.|[^\"\\])*\"")
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


_WORD = r"[A-Za-z_$][\w$]*"
_MODIFIERS = r"(?:(?:@[\w.]+(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|sealed|partial|override|virtual|async|readonly|synchronized|native|strictfp|default|unsafe|extern|new|open|fileprivate|mutating|case|implicit|lazy|indirect)\s+)*"
_TYPE = r"[A-Za-z_][\w.:<>,\[\]?&*\s]*?"

# Where a declaration begins, by language, and how it ends: "block" after the brackets of a body, "any" after a
# body or a semicolon, "line" at the statement's end, "item" like block but without what follows a closing brace.
_HEADS: dict[str, list[tuple[str, str]]] = {
    "javascript": [
        (r"export\b", "line"),
        (rf"(?:async\s+)?function\s*\*?\s*{_WORD}\s*(?:<[^()]*>)?(?=\s*\()", "block"),
        (rf"(?<!abstract )class\s+{_WORD}", "block"),
        (rf"(?:async\s+)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_WORD})\s*(?::\s*[^=;{{}}()]+)?=>", "arrow"),
    ],
    "rust": [
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\"|\s*)?)\s+)*fn\s+\w+", "block"),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?impl\b", "block"),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+\w+", "any"),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:auto\s+)?trait\s+\w+", "any"),
        (r"(?:pub(?:\([^)]*\))?\s+)?mod\s+\w+", "any"),
        (r"macro_rules!\s*\w+", "block"),
    ],
    "go": [(r"func\s+(?:\([^)]*\)\s*)?\w+", "block"), (r"type\b", "line")],
    "java": [
        (rf"{_MODIFIERS}(?:class|interface|enum)\s+{_WORD}", "block"),
        (rf"{_MODIFIERS}(?:<[^>]*>\s*)?(?!return\b|new\b|else\b|throw\b)(?:{_TYPE}\s+)?(?!(?:if|for|while|switch|catch|synchronized|try)\b){_WORD}\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?(?={{)", "block"),
    ],
    "csharp": [
        (rf"{_MODIFIERS}(?:class|struct)\s+{_WORD}", "block"),
    ],
    "cpp": [
        (r"template\s*<", "template"),
        (r"(?:inline\s+)?namespace\b[\w:\s]*(?={)", "block"),
        (rf"class\s+[\w:\s]*?{_WORD}[^;{{}}()]*(?={{)", "block"),
        (rf"(?!(?:if|for|while|switch|return|else|do|catch|namespace|class|struct|enum|union|typedef|using)\b){_TYPE}[\s*&]+[\w:~]+(?:operator\s*\S+?)?\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|final|->\s*[\w:<>&*\s]+|:\s*[^{{;]*|\s)*(?={{)", "block"),
    ],
    "c": [
        (rf"(?!(?:if|for|while|switch|return|else|do|struct\s+\w+\s*{{|enum)\b){_TYPE}[\s*]+\w+\s*\([^;{{}}]*\)\s*(?={{)", "block"),
        (r"struct\s+\w*\s*(?={)", "block"),
        (r"enum\s+\w*\s*(?={)", "block"),
        (r"(?:struct|enum)\s+\w+", "bare"),
    ],
    "php": [
        (r"function\s+&?\s*\w+(?=\s*\()", "block"),
        (r"(?:(?:abstract|final|readonly)\s+)*class\s+\w+", "block"),
    ],
    "swift": [
        (rf"{_MODIFIERS}(?:func|class|struct|enum|actor|extension)\s+(?!func\b|var\b|let\b)\S", "block"),
    ],
    "scala": [
        (rf"{_MODIFIERS}(?:class|object)\s+{_WORD}", "optional"),
        (rf"{_MODIFIERS}def\s+\S+", "line"),
    ],
    "ruby": [],
}
_HEADS["typescript"] = [*_HEADS["javascript"], (rf"interface\s+{_WORD}", "block"), (rf"type\s+{_WORD}(?:<[^=]*>)?\s*=", "line")]
_HEADS["tsx"] = _HEADS["typescript"]
_COMPILED = {language: [(re.compile(p), end) for p, end in heads] for language, heads in _HEADS.items()}
_CLOSING = {"{": "}", "(": ")", "[": "]"}
_BEGIN = re.compile(r"[\w$@(~]")


def _matched(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at `at`; the text's end without one."""
    depth = 0
    for m in re.finditer(r"[{}()\[\]]", text[at:]):
        depth += 1 if m[0] in _CLOSING else -1
        if depth == 0:
            return at + m.end()
    return len(text)


def _end(text: str, at: int, how: str) -> int | None:
    """Where a declaration ends whose head ends at `at`; None if it is none."""
    if how == "bare":
        return at
    if how == "template":
        depth, at = 1, at
        while at < len(text) and depth:
            depth += {"<": 1, ">": -1}.get(text[at], 0)
            at += 1
        how = "any"
    if how == "arrow":
        body = re.compile(r"\s*").match(text, at).end()
        if text[body : body + 1] == "{":
            return _matched(text, body)
        how, at = "expression", body
    k = at
    while k < len(text):
        c = text[k]
        if c == "{":
            end = _matched(text, k)
            if how in ("line", "expression"):
                rest = re.compile(r"[ \t]*;?").match(text, end)
                if how == "line" and re.compile(r"\s*[|&]").match(text, end):
                    k = end
                    continue
                if how == "line" and rest[0].endswith(";"):
                    return rest.end()
                if how == "line":
                    return end
                k = end
                continue
            if how == "any" and text[end : end + 1] == ";":
                return end + 1
            return end
        if c in "([":
            k = _matched(text, k)
            continue
        if c in ")]}":
            return k if how in ("line", "expression") else None
        if c == ";":
            return {"line": k + 1, "any": k + 1, "expression": k}.get(how)
        if c == "," and how == "expression":
            return k
        if c == "\n" and how in ("line", "expression", "optional"):
            before = text[at:k].rstrip()
            if how == "optional" and not re.match(r"\s*(?:extends\b|with\b|\{)", text[k:]):
                return at + len(text[at:k].rstrip())
            if how != "optional" and before and not before.endswith(("=", ",", "|", "&", "+", "(", "=>", "extends")) and not re.match(r"\s*(?:[|&.?:+]|\{)", text[k:]):
                return at + len(text[at:k].rstrip())
        k += 1
    return len(text.rstrip()) if how in ("line", "expression", "optional") else None


def brace_spans(source: str, language: str) -> list[Span]:
    """(begin, end) of the outermost declarations of a language with braces."""
    text, heads = blanked(source, language), _COMPILED.get(language, [])
    found: list[Span] = []
    at, size = 0, len(text)
    while heads and at < size:
        m = _BEGIN.search(text, at)
        if not m:
            break
        at = m.start()
        before = text[at - 1] if at else "\n"
        if before.isalnum() or before in "_$.":
            at += 1
            continue
        for pattern, how in heads:
            head = pattern.match(text, at)
            end = _end(text, head.end(), how) if head else None
            if end:
                found.append((at, end))
                at = end
                break
        else:
            word = re.compile(r"[\w$]+").match(text, at)
            at = word.end() if word else at + 1
    return found


def spans(source: str, language: str) -> list[Span]:
    if language not in SPLITTABLE_NODES:
        return []
    return python_spans(source) if language == "python" else brace_spans(source, language)


PIECES = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("content", T.StringType()),
    ]
)


def syntax_chunks(files: DataFrame, find: Callable[[str, str], list[Span]] = spans) -> DataFrame:
    """A chunk per outermost declaration of the files whose language has a splitter; another `find`
    replaces the splitters of this module."""
    ship(files.sparkSession)
    path = F.col("file_path") if "file_path" in files.columns else F.lit("")
    language = X.ast_language(X.extension(F.col("relative_path")))
    some = files.select(path.alias("file_path"), "relative_path", language.alias("language"), "content").where("language is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[tuple] = []
            for file_path, relative, name, source in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for begin, end in find(source or "", name):
                    text = source[begin:end]
                    if text.strip():
                        first = source.count("\n", 0, begin) + 1
                        own.append((file_path, relative, name, first, first + text.count("\n"), text))
            columns = list(zip(*own)) or [[]] * len(PIECES)
            kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, kinds)], names=PIECES.names)

    pieces = some.mapInArrow(run, PIECES)
    return pieces.withColumn("chunk_id", ids.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("content"))).select(COLUMNS)
