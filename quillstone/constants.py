"""Fixed values that results depend on, stated plainly."""

from __future__ import annotations

# Canonical languages, in an append-only order, and their aliases.
LANGUAGES = ["C", "C#", "C++", "Go", "Java", "JavaScript", "PHP", "Python", "Rust", "Ruby", "HTML", "TypeScript"]
LANGUAGE_ALIASES = {"cpp": "C++", "csharp": "C#", "cs": "C#", "golang": "Go", "js": "JavaScript", "py": "Python", "ts": "TypeScript"}
UNKNOWN_LANGUAGE_CODE = 255
CHECKPOINT_EVERY = 50_000

# Classes in their semantic order, and class labels of one source.
CLASS_NAMES = ["human", "ai"]
SOURCE_A_LABELS = {0: "human", 1: "ai", 2: "co_authored", 3: "ai"}

# Agent signatures, by family. Matched without regard to case, ^ and $ at each line.
AGENT_SIGNATURES = {
    "claude-code": [
        ("trailer", r"^\s*Co-Authored-By:\s*Claude\b"),
        ("footer", r"Generated with .{0,20}Claude Code"),
        ("identity", r"^claude\[bot\]\s*<"),
        ("identity", r"<[^>]*@anthropic\.com>"),
    ],
    "cursor": [
        ("trailer", r"^\s*Co-Authored-By:\s*Cursor\b"),
        ("identity", r"<cursoragent@cursor\.com>"),
        ("identity", r"^Cursor Agent\s*<"),
        ("identity", r"\bcursor\[bot\]"),
    ],
    "copilot": [
        ("trailer", r"^\s*Co-Authored-By:\s*Copilot\b"),
        ("identity", r"^copilot(-swe-agent)?\[bot\]\s*<"),
    ],
    "devin": [
        ("identity", r"devin-ai-integration\[bot\]"),
        ("identity", r"^Devin AI\s*<"),
        ("trailer", r"^\s*Co-Authored-By:\s*Devin\b"),
    ],
    "codex": [
        ("footer", r"https://chatgpt\.com/codex/"),
        ("trailer", r"^\s*Co-Authored-By:\s*Codex\b"),
        ("identity", r"^chatgpt-codex-connector\[bot\]"),
    ],
    "aider": [
        ("subject", r"\(aider\)\s*$"),
    ],
    "gemini-cli": [
        ("trailer", r"^\s*Co-Authored-By:\s*Gemini\b"),
        ("identity", r"^gemini-code-assist\[bot\]"),
    ],
    "codegen-generic": [
        ("trailer", r"^\s*Co-Authored-By:\s*(OpenHands|Sweep|Codegen|Jules)\b"),
        ("identity", r"^(openhands|sweep-ai|jules)\[bot\]"),
    ],
}

# Automation identities that aren't agents.
EXCLUDED_BOTS = [
    r"\[bot\]\s*<",
    r"\[bot\]@users\.noreply\.github\.com",
    r"^Vercel Release Bot\s*<",
    r"release[- ]bot\s*<",
    r"\bsnyk-bot\b",
    r"\bsemantic-release-bot\b",
    r"\bgreenkeeper\b",
    r"\bweblate\b",
    r"\bcrowdin[- ]?bot\b",
    r"\btravis[- ]ci\b",
    r"\bnetlify\[?bot\]?\b",
]
AUTONOMOUS_AUTHOR = r"\[bot\]|devin-ai-integration|^Devin AI\s*<"
REACT_LANGUAGES = ["TypeScript", "JavaScript"]
REACT_IMPORT = r"""(from\s+|require\(\s*)['"]react(-dom)?(/[^'"]*)?['"]"""

# Path extensions and globs of the corpus, and per-language settings.
CORPUS_LANGUAGES = {
    "TypeScript": {"extensions": [".ts", ".tsx", ".mts", ".cts"]},
    "JavaScript": {"extensions": [".js", ".jsx", ".mjs", ".cjs"]},
    "Python": {"extensions": [".py"], "exclude": ["*_pb2.py", "*_pb2_grpc.py", "migrations/*", "*/migrations/*"]},
    "C++": {
        "extensions": [".cpp", ".cc", ".cxx", ".h", ".hpp"],
        "exclude": ["third_party/*", "*/third_party/*", "3rdparty/*", "*/3rdparty/*", "external/*", "*/external/*", "extern/*", "*/extern/*", "*.pb.h", "*.pb.cc"],
        "min_signed_commits": 5,
        "rows_per_class_per_repo": 1500,
    },
    "C#": {
        "extensions": [".cs"],
        "exclude": ["*.Designer.cs", "*.g.cs", "*.g.i.cs", "Migrations/*", "*/Migrations/*", "*AssemblyInfo.cs"],
        "min_signed_commits": 5,
        "rows_per_class_per_repo": 1500,
    },
}
EXCLUDE_GLOBS = ["vendor/*", "*/vendor/*", "node_modules/*", "*/node_modules/*", "dist/*", "build/*", "*.min.js", "*.d.ts", "*.generated.*", "*.gen.ts", "__generated__/*", "*/__generated__/*"]
LICENSES = {
    "permissive": ["MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "0BSD", "Unlicense", "CC0-1.0", "CC-BY-4.0", "BSL-1.0"],
    "copyleft": ["GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"],
}
CORPUS = {
    "min_signed_commits": 20,
    "ai_since": "2024-01-01",
    "human_until": "2021-06-01",
    "min_changed_lines": 5,
    "max_files_per_commit": 5,
    "rows_per_class_per_repo": 500,
    "max_repo_share": 0.05,
    "human_pool_factor": 3,
    "split_percent": {"validation": 10, "test": 15},
}

# Extensions that are scored, and the language each stands for.
SUPPORTED_EXTENSIONS = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
}
MAX_FILES_SCORED = 50

# Patterns of the text features.
TODO = r"\b(TODO|FIXME|XXX|HACK)\b"
TYPOGRAPHIC = "[—–→←↔⇒•…“”‘’✓✗≈≤≥×]"
NULL_CHECK = r"(===?|!==?)\s*(null|undefined|nullptr)\b|\bis (not )?None\b|\?\.|\?\?|\bnullptr\b|ArgumentNullException|ThrowIfNull"
ANY_TYPE = r":\s*any\b|as any\b|<any>"
LOG_CALL = r"\b(console\.(log|warn|error|info|debug)|logger\.|logging\.|log\.(info|warn|error|debug)|print\(|Console\.Write|Debug\.Log|std::cout|std::cerr|printf\(|_logger\.|LOG\()"
TOKEN = r"\w+|[^\w\s]"
FEATURES = [
    "mean_comment_words",
    "comment_char_ratio",
    "comment_line_ratio",
    "todo_count",
    "trailing_ws_ratio",
    "blank_line_ratio",
    "typographic_symbols",
    "non_ascii_ratio",
    "null_check_density",
    "any_density",
    "log_call_density",
    "max_indent_depth",
    "token_entropy",
]

# Training of the scoring head.
TRAINING = {"epochs": 200, "batch_size": 64, "lr": 0.001, "weight_decay": 0.0001, "patience": 20, "lr_patience": 5, "lr_factor": 0.5, "min_lr": 0.00001, "seed": 42}
HIDDEN = [128, 64]
DROPOUT = 0.2
