"""Settings and fixed tables of the engine."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Extensions that are indexed, in the case that files must have.
SUPPORTED_EXTENSIONS = (
    "py rs js ts tsx jsx go java cpp cc cxx c h hpp rb php swift kt scala cs fs ml mli hs lua sh bash zsh pl pm r jl ex exs erl hrl "
    "clj cljs lisp el vim sql graphql proto thrift yaml yml toml json xml html css scss sass less md rst tex"
).split()

# Names, in lower case, of files that are indexed without an extension.
EXTENSIONLESS_FILES = ["dockerfile", "makefile", "justfile", "rakefile"]

# Names that are recorded with an index, and applied where asked for.
DEFAULT_IGNORE_PATTERNS = "node_modules .git .hg .svn target dist build __pycache__ .pytest_cache .venv venv .tox .eggs".split()

# The ignore file of each folder, and the folder below the user's home that holds a global one.
IGNORE_FILE = ".contextignore"
GLOBAL_IGNORE_FOLDER = ".context"

# The extensions of each language that has a syntax splitter.
LANGUAGE_EXTENSIONS = {
    "python": "py pyw pyi",
    "javascript": "js mjs cjs jsx",
    "typescript": "ts mts cts",
    "tsx": "tsx",
    "rust": "rs",
    "go": "go",
    "java": "java",
    "cpp": "cpp cxx cc c++ hpp hxx h++",
    "c": "c h",
    "ruby": "rb",
    "php": "php",
    "swift": "swift",
    "scala": "scala",
    "csharp": "cs",
}
EXTENSION_LANGUAGE = {ext: language for language, exts in LANGUAGE_EXTENSIONS.items() for ext in exts.split()}

# The syntax nodes that become chunks.
_SCRIPT_NODES = "function_declaration arrow_function class_declaration method_definition export_statement"
SPLITTABLE_NODES = {
    "python": "function_definition class_definition decorated_definition",
    "javascript": _SCRIPT_NODES,
    "typescript": f"{_SCRIPT_NODES} interface_declaration type_alias_declaration",
    "tsx": f"{_SCRIPT_NODES} interface_declaration type_alias_declaration",
    "rust": "function_item impl_item struct_item enum_item trait_item mod_item macro_definition",
    "go": "function_declaration method_declaration type_declaration",
    "java": "method_declaration class_declaration interface_declaration constructor_declaration enum_declaration",
    "cpp": "function_definition class_specifier namespace_definition template_declaration",
    "c": "function_definition struct_specifier enum_specifier",
    "ruby": "method_definition class_definition module_definition",
    "php": "function_definition class_declaration method_declaration",
    "swift": "function_declaration class_declaration struct_declaration",
    "scala": "function_definition class_definition object_definition",
    "csharp": "method_declaration class_declaration struct_declaration",
}

# Extensions whose fallback language is not the extension itself.
FALLBACK_LANGUAGE = {"md": "markdown", "rst": "markdown", "yml": "yaml"}
MARKDOWN_EXTENSIONS = ["md", "rst"]

# Bytes that a line is taken to have, and the ranks' offset in reciprocal rank fusion.
BYTES_PER_LINE = 80
RRF_OFFSET = 60

# Parameters of the lexical score.
BM25_K1 = 1.2
BM25_B = 0.75
MOST_TOKEN_BYTES = 40


@dataclass(frozen=True)
class SplitConfig:
    """How texts are cut: bytes of a chunk and lines that neighbours share."""

    max_chunk_bytes: int = 4096
    overlap_lines: int = 3
    min_chunk_lines: int = 5
    target_chunk_lines: int = 50

    @property
    def lines_per_chunk(self) -> int:
        return max(self.max_chunk_bytes // BYTES_PER_LINE, 1)


@dataclass(frozen=True)
class Settings:
    """The engine's settings; from_environment() reads those that a user sets."""

    embedding_url: str | None = None
    embedding_model: str = "all-minilm"
    embedding_api_key: str | None = None
    embedding_dimension: int = 384
    embedding_rpm: int = 400
    embedding_tpm: int = 1_600_000
    vector_url: str | None = None
    vector_token: str | None = None
    batch_size: int = 32
    concurrency: int = 32
    chunk_size: int = 512
    chunk_overlap: int = 64
    max_file_size: int = 1 << 20
    follow_symlinks: bool = False
    extensions: tuple[str, ...] = tuple(SUPPORTED_EXTENSIONS)
    ignore_patterns: tuple[str, ...] = tuple(DEFAULT_IGNORE_PATTERNS)
    ignore_file: str = IGNORE_FILE
    apply_default_ignores: bool = False
    apply_max_file_size: bool = False
    split: SplitConfig = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        if self.split is None:
            object.__setattr__(self, "split", SplitConfig(self.chunk_size, self.chunk_overlap // BYTES_PER_LINE))

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] | None = None) -> Settings:
        """Semantic search is on only if EMBEDDING_URL is there and not empty; vectors are in a service only if MILVUS_URL is."""
        env = os.environ if environment is None else environment
        given: dict[str, object] = {"embedding_url": env.get("EMBEDDING_URL") or None, "embedding_api_key": env.get("EMBEDDING_API_KEY") or None}
        given |= {"vector_url": env.get("MILVUS_URL") or None, "vector_token": env.get("MILVUS_TOKEN") or None}
        if env.get("EMBEDDING_MODEL"):
            given["embedding_model"] = env["EMBEDDING_MODEL"]
        numbers = {
            "EMBEDDING_DIMENSION": "embedding_dimension",
            "EMBEDDING_RPM": "embedding_rpm",
            "EMBEDDING_TPM": "embedding_tpm",
            "CHUNK_SIZE": "chunk_size",
            "CHUNK_OVERLAP": "chunk_overlap",
            "BATCH_SIZE": "batch_size",
            "CONCURRENCY": "concurrency",
            "INDEXING_CONCURRENCY": "concurrency",
            "MAX_FILE_SIZE": "max_file_size",
        }
        for name, setting in numbers.items():
            if env.get(name, "").strip().isdigit():
                given[setting] = int(env[name])
        if env.get("FOLLOW_SYMLINKS"):
            given["follow_symlinks"] = env["FOLLOW_SYMLINKS"].lower() in ("1", "true")
        return cls(**given)  # type: ignore[arg-type]


PIPELINE = SplitConfig(512, 0)
STANDALONE = SplitConfig()
