"""Language and framework settings.

FIXED VALUES: extensions, limits, patterns and words below must be exactly these for right results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx", ".java": "java",
    ".go": "go", ".html": "html", ".css": "css", ".cpp": "cpp", ".c": "c", ".rb": "ruby",
}
INDEXED_EXTENSIONS = (".py", ".java", ".js", ".jsx", ".ts", ".tsx", ".go", ".cpp", ".c")
LANGUAGE_ALIASES = {"typescript.tsx": "tsx", "typescript.jsx": "jsx", "javascriptreact": "jsx", "typescriptreact": "tsx"}


@dataclass(frozen=True)
class Language:
    """Chunk limits in characters; patterns of ignored and of structural lines; named special patterns."""

    max_chars: int = 16000
    coalesce_chars: int = 4000
    ignored: tuple[str, ...] = ()
    structure: tuple[str, ...] = ()
    special: dict[str, str] = field(default_factory=dict)


BLOCK_COMMENT, LINE_COMMENT, ES_IMPORT = r"/\*[\s\S]*?\*/", r"//.*$", r"^\s*import\s+.*$"
USE_STATE = r"(const|let)\s+\[\w+,\s*set\w+\]\s*=\s*useState"

LANGUAGES = {
    "java": Language(
        3200, 1200,
        (r"import\s+[^;]+;", r"^\s*package\s+[^;]+;", LINE_COMMENT, BLOCK_COMMENT),
        (
            r"(public|private|protected)?\s+(static)?\s+(class|interface|enum)\s+\w+",
            r"(public|private|protected)?\s+(static)?\s+\w+(<[^>]+>)?\s+\w+\s*\([^)]*\)",
            r"@\w+(\([^)]*\))?",
            r"@Service|@Controller|@Repository|@Component|@Entity",
            r"@RestController|@RequestMapping|@GetMapping|@PostMapping",
        ),
        {"controller_methods": r"@(Get|Post|Put|Delete|Patch)Mapping", "entity_classes": r"@Entity|@Table", "services": r"@Service"},
    ),
    "python": Language(
        4000, 1600,
        (r"^\s*import\s+.*$", r"^\s*from\s+.*\s+import\s+.*$", r"^\s*#.*$", r'"""[\s\S]*?"""', r"'''[\s\S]*?'''"),
        (r"^\s*def\s+\w+\s*\(", r"^\s*class\s+\w+", r"^\s*@\w+", r"^\s*@(app|router)\.(get|post|put|delete|patch)"),
        {"flask_routes": r"@app\.(get|post|put|delete|patch)", "fastapi_routes": r"@(router|app)\.(get|post|put|delete|patch)", "django_views": r"class\s+\w+View\("},
    ),
    "go": Language(
        3200, 1200,
        (r"^\s*import\s+\(", r'^\s*import\s+"[^"]+"', LINE_COMMENT, BLOCK_COMMENT),
        (r"func\s+\w+\s*\(", r"func\s+\(\w+\s+\*?\w+\)\s+\w+\s*\(", r"type\s+\w+\s+struct", r"type\s+\w+\s+interface"),
        {
            "handlers": r"func\s+\w+\(w\s+http\.ResponseWriter,\s*r\s+\*http\.Request\)",
            "middleware": r"func\s+\w+\(.*\)\s+http\.Handler",
            "gin_handlers": r"func\s+\w+\(c\s+\*gin\.Context\)",
        },
    ),
    "javascript": Language(
        3200, 1200,
        (ES_IMPORT, r"^\s*const\s+.*\s*=\s*require\(.*\);", LINE_COMMENT, BLOCK_COMMENT),
        (
            r"function\s+\w+\s*\(", r"const\s+\w+\s*=\s*\(.*\)\s*=>", r"let\s+\w+\s*=\s*\(.*\)\s*=>", r"class\s+\w+",
            r"export\s+(default\s+)?(function|class|const)", r"export\s+default\s+\{",
        ),
        {
            "react_components": r"(function|const)\s+(\w+)\s*=.*React|React\.Component|React\.PureComponent|extends\s+(React\.)?Component",
            "event_handlers": r"(function|const)\s+handle\w+\s*=",
            "hooks": USE_STATE,
        },
    ),
    "typescript": Language(
        3200, 1200,
        (ES_IMPORT, LINE_COMMENT, BLOCK_COMMENT),
        (
            r"function\s+\w+<?\w*>?\s*\(", r"const\s+\w+\s*=\s*\(.*\)\s*:", r"class\s+\w+<?\w*>?", r"interface\s+\w+", r"type\s+\w+\s*=",
            r"export\s+(default\s+)?(function|class|const|interface|type)",
        ),
        {
            "react_components": r"(function|const)\s+(\w+)(\s*:\s*React|\s*=.*React\.FC|\s*=.*React|React\.Component|React\.PureComponent|extends\s+(React\.)?Component)",
            "hooks": USE_STATE,
            "reducers": r"(function|const)\s+\w+Reducer",
        },
    ),
    "jsx": Language(
        2800, 1200,
        (ES_IMPORT, LINE_COMMENT, BLOCK_COMMENT),
        (r"function\s+\w+\s*\(", r"const\s+\w+\s*=\s*\(.*\)\s*=>", r"class\s+\w+\s+extends\s+React\.Component", r"return\s+\(\s*<", r"<\w+\s+\w+.*>"),
        {"components": r"(function|const)\s+(\w+)\s*=.*?\(\s*\)\s*=>\s*\{.*?return\s+<", "hooks": USE_STATE, "effects": r"useEffect\(\(\)\s*=>"},
    ),
    "tsx": Language(
        2800, 1200,
        (ES_IMPORT, LINE_COMMENT, BLOCK_COMMENT),
        (
            r"function\s+\w+<?\w*>?\s*\(", r"const\s+\w+\s*=\s*\(.*\)\s*:", r"class\s+\w+<?\w*>?\s+extends\s+React\.Component",
            r"return\s+\(\s*<", r"<\w+\s+\w+.*>", r"interface\s+\w+Props",
        ),
        {"components": r"(function|const)\s+(\w+)\s*:\s*React\.FC|=.*?\(\s*\)\s*=>\s*\{.*?return\s+<", "hooks": USE_STATE, "effects": r"useEffect\(\(\)\s*=>"},
    ),
    "html": Language(
        4000, 1600,
        (r"<!--.*?-->", r"<link\s+.*?>", r"<meta\s+.*?>", r"<script\s+src=.*?></script>", r"<style\s+src=.*?></style>"),
        (r"<div\s+.*?class=.*?>", r"<(header|footer|main|nav|section|article|aside)>", r"<form\s+.*?>", r"<template\s+.*?>"),
        {"scripts": r"<script>[\s\S]*?</script>", "styles": r"<style>[\s\S]*?</style>", "forms": r"<form[\s\S]*?</form>"},
    ),
    "css": Language(
        4000, 1600,
        (BLOCK_COMMENT, r"@import\s+.*?;"),
        (r"(\.|#)\w+\s*\{", r"@media\s+.*?\{", r"@keyframes\s+.*?\{"),
        {"media_queries": r"@media\s+.*?\{[\s\S]*?\}", "animations": r"@keyframes\s+.*?\{[\s\S]*?\}"},
    ),
    "default": Language(),
}

#: By regular expression, in this order; for chunks.
FRAMEWORK_PATTERNS = {
    "spring": (r"@SpringBootApplication", r"@Controller", r"@RestController", r"@Service", r"@Repository", r"@Component"),
    "django": (r"from\s+django", r"@login_required", r"class\s+\w+View\(", r"class\s+\w+ModelAdmin\("),
    "flask": (r"from\s+flask", r"@app\.route", r"Flask\(__name__\)"),
    "react": (r"import\s+.+?\s+from\s+['\"]react['\"]", r"React\.Component", r"extends\s+Component", r"useState", r"useEffect"),
    "vue": (r"import\s+.+?\s+from\s+['\"]vue['\"]", r"createApp", r"<template>", r"<script\s+setup>"),
    "angular": (r"import\s+.+?\s+from\s+['\"]@angular", r"@Component", r"@NgModule", r"@Injectable"),
}
#: By substring, in this order; for files.
FRAMEWORK_WORDS = {
    "react": ("import React", "React.Component", "useState", "useEffect"),
    "angular": ("@Component", "@NgModule", "@Injectable"),
    "vue": ("createApp", "<template>", "defineComponent"),
    "spring": ("@SpringBootApplication", "@Controller", "@Service", "@Repository"),
    "django": ("from django",),
    "flask": ("Flask(__name__)", "@app.route"),
}

CATEGORY_ORDER = ("package", "import", "class", "interface", "function", "method", "field", "variable")


def language(name: str) -> Language:
    name = LANGUAGE_ALIASES.get(name, name)
    return LANGUAGES.get(name, LANGUAGES["default"])
