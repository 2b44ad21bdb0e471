"""Source files that nobody on the team wrote by hand: generated, minified, vendored, or data saved as code.

Header and layout rules look at one file: a head comment that says that a tool made the file (what stands in quotation
marks is talk about such a comment), the name of a lock file, folders and suffixes that only generators use, code with
next to no white space, files that are a literal and little else, line after line of the
same shape, the notices of libraries.

Vendored code is found by Merkle digests: a file is cut into blocks (functions, methods, classes) whose lines are hashed
without white space and comments, the digests of its blocks make the file's, and the digests and relative paths of all
files below make the folder's.  A folder that stands in two repositories marks its files; so does a share of
``min_share`` of a file's blocks, which finds copies that were renamed, stripped of their notice or lightly patched.

Scale: one pass over the sources, whose digests are kept in the shared folder; only these travel; a block or folder that all repositories have is one
row after the map-side combine (least and greatest repository), never a list.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.lineage import cut

# What head comments of generated files say.
_MADE = re.compile(
    r"@generated\b|\bautogenerated\b(?!\s+\S+\s+ids)|\bcode generated by\b|\bdo not (?:edit|modify|change)\b|\bnicht von hand\b|automatisch (?:erzeugt|erstellt|generiert)"
    r"|自动生成|请勿(?:手动)?(?:修改|编辑)|no (?:editar|modificar)\b|generado automáticamente|\b(?:written|generated|created|produced|built) automatically\b|\bautomatically (?:written|generated|created|produced)\b"
    r"|\bmachine[- ](?:made|written|generated) (?:from|by)\b|\bregenerate instead\b|\bcompiled with \S+ v?\d|\bchanges will be lost\b|\b(?:file|module|code) (?:is|was) (?:auto[- ]?)?generated\b",
    re.I,
)
# Notices that libraries carry.
_NOTICE = re.compile(r"/\*!\s*[\w.-]+(?: \w+)? v?\d+\.\d|@license\b[\s\S]*@version\b|@version\b[\s\S]*@license\b|\bsee LICENSE\.\S+|^\s*//\s*from \S+@\d+\.\d|\blibrary\s+Release \d+\.\d", re.M)
# Folders and suffixes of generators, of libraries, and names of lock files.
_MADE_PATH = re.compile(r"(?:^|/)(?:gen|__generated__|generated|\.generated)/|(?:_pb|\.pb|\.generated|\.g|\.gen)\.[a-z]+$")
_THEIR_PATH = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|third_party|third-party|vendor)/")
_LOCK = re.compile(r"(?:^|/)(?:package-lock|npm-shrinkwrap|composer\.lock|deno\.lock|bun\.lock|pnpm-lock)(?:\.json|\.yaml)?$")
#: strings, with the colon of keys, and brackets of JSON
_JSON = re.compile(r'"(?:\\.|[^"\\\n])*"(?:\s*:)?|[{}\[\]]')

_HEAD = re.compile(r"\s*(?:#![^\n]*\n\s*)?((?:(?://[^\n]*(?:\n|$)|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|<script[^>]*>|/\* eslint[^\n]*)\s*)+)")
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|‘[^’\n]*’')
_LITERAL = re.compile(r'"(?:\\[\s\S]|[^"\\\n])*"|\'(?:\\[\s\S]|[^\'\\\n])*\'|`(?:\\[\s\S]|[^`\\])*`|//[^\n]*|/\*[\s\S]*?\*/|-?\b(?:0x[0-9a-fA-F]+|\d[\d._]*(?:e[+-]?\d+)?)\b|#[0-9a-fA-F]{6}\b')
_RUNS = re.compile(r"\bfunction\b|=>|\breturn\b|\bclass\b|\bif\b|\binterface\b|\bimport\b")
#: begins a block, in a line without white space
_BLOCK = re.compile(r"(?:export|default|async|static|public|private)*(?:function|class[A-Z]|(?:const|let|var)[\w$]+=(?:async)?(?:function|\()|(?!(?:if|for|while|switch|catch|with)\()[\w$#]+\([^()]*\)\{$)")
_SPACE = re.compile(r"\s+")

_NAMED = re.compile(r'"[^"\n]*"|\'[^\'\n]*\'|`[^`\n]*`|\d[\w.]*|[A-Za-z_$][\w$]*')
_KEPT = frozenset("export const function class return let var if for while import from async default new this get set".split())
_STATES = re.compile(r"^(?:export|const|var|let|class|function|module\.exports)\b", re.M)

CODE = frozenset({"js", "jsx", "ts", "tsx", "mjs", "cjs", "vue", "svelte"})


def header_rules(path: str, text: str) -> bool:
    """A tool's head comment, a library's notice, or a name that only tools and libraries use."""
    if _MADE_PATH.search(path) or _THEIR_PATH.search(path) or _LOCK.search(path):
        return True
    if path.endswith(".json"):
        return _locked(text)
    head = _HEAD.match(text)
    return bool(head) and bool(_MADE.search(_QUOTED.sub(" ", head[1])) or _NOTICE.search(head[1]))


def _locked(text: str) -> bool:
    """The version of a lock file is among the outermost keys, wherever it stands."""
    if '"lockfileVersion"' not in text:
        return False
    depth = 0
    for m in _JSON.finditer(text):
        if depth <= 1 and m[0].startswith('"lockfileVersion"') and m[0][-1] == ":":
            return True
        depth += (m[0] in "{[") - (m[0] in "}]")
    return False


def layout_rules(path: str, text: str, *, min_minified: int = 200, max_space: float = 0.06, min_blob: int = 400, min_literal: float = 0.7) -> bool:
    """Minified code (next to no white space outside literals) or a data blob (literals and no code that runs)."""
    if path.rpartition(".")[2].lower() not in CODE or len(text) < min_minified:
        return False
    code, literal = [], 0
    at = 0
    for m in _LITERAL.finditer(text):
        code.append(text[at : m.start()])
        at = m.end()
        if m[0][0] != "/":
            literal += at - m.start()
    code.append(text[at:])
    rest = " ".join(code)
    bare = _SPACE.sub("", rest)
    if len(bare) >= min_minified // 2 and len(rest) - len(bare) - len(code) + 1 < max_space * len(rest) and len(rest) >= min_minified // 2 and "<!DOCTYPE" not in text[:100]:
        return True
    return len(text) >= min_blob and literal >= min_literal * (literal + len(bare)) and not _RUNS.search(rest)


def repeats_itself(path: str, text: str, *, min_lines: int = 12, few_shapes: float = 0.25, most: float = 0.9) -> bool:
    """Statement after statement of the same few shapes, as only a program writes them (accessors, enumerations, stubs)."""
    if path.rpartition(".")[2].lower() not in CODE:
        return False
    lines = [line for line in text.split("\n") if len(line) > 3 and not line.isspace()]
    if len(lines) < min_lines or not _STATES.search(text):
        return False
    counts: Counter[str] = Counter()
    for line in lines:
        if len(shape := _NAMED.sub(_kind, line.strip())) > 3:
            counts[shape] += 1
            if len(counts) > few_shapes * len(lines):  # shapes never get fewer: no later line can change the result
                return False
    shapes = counts.total()
    return shapes >= min_lines and len(counts) <= few_shapes * shapes and sum(n for _, n in counts.most_common(4)) >= most * shapes


def _kind(m: re.Match) -> str:
    word = m[0]
    return word if word in _KEPT else "S" if word[0] in "\"'`" else "N" if word[0].isdigit() else "I"


def blocks(text: str) -> dict[int, int]:
    """Digest -> characters of every block of a file, without white space, blank and comment lines."""
    found: dict[int, int] = {}
    lines: list[str] = []

    def close() -> None:
        whole = "\n".join(lines)
        if whole:
            found[xxhash.xxh64_intdigest(whole.encode("utf-8", "surrogatepass"))] = len(whole)
        lines.clear()

    for line in text.split("\n"):
        line = _SPACE.sub("", line)
        if not line or line.startswith(("//", "/*", "*")):
            continue
        if _BLOCK.match(line):
            close()
        lines.append(line)
    close()
    return found


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, repo, path, text in zip(pdf["file_id"].tolist(), pdf["repo"].tolist(), pdf["file_path"].tolist(), pdf["source_code"].tolist(), strict=True):
            path = path or ""
            found = blocks(text)
            whole = xxhash.xxh64_intdigest(np.fromiter(found, np.uint64, len(found)).tobytes())
            digests = np.fromiter(found, np.uint64, len(found)).view(np.int64)
            rows.append((file_id, repo, path, header_rules(path, text) or layout_rules(path, text) or repeats_itself(path, text), digests, list(found.values()), whole - (1 << 63)))
        yield pd.DataFrame(rows, columns=["file_id", "repo", "path", "ruled", "digests", "sizes", "whole"])


def looked_at(files: DataFrame) -> DataFrame:
    """One row per file: ruled (a header or layout rule holds) and its block digests; null code and null ids are left out."""
    files = files.select("file_id", "repo", "file_path", "source_code").filter("file_id is not null and source_code is not null")
    return files.mapInPandas(_look, "file_id bigint, repo string, path string, ruled boolean, digests array<bigint>, sizes array<int>, whole bigint")


def shared_folders(looked: DataFrame, *, min_chars: int = 200) -> DataFrame:
    """(repo, folder) of every folder whose whole subtree stands in another repository too."""
    last = looked.filter("repo is not null").groupBy("repo", "path").agg(F.max_by(F.struct("whole", F.aggregate("sizes", F.lit(0), lambda a, x: a + x).alias("chars")), "file_id").alias("f"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("folder"), F.array_join(F.slice(parts, n + 1, F.size(parts) - n), "/").alias("below")))
    below = last.filter("path like '%/%'").select("repo", "f.*", F.explode(above).alias("a")).select("repo", "chars", "a.folder", F.xxhash64("a.below", "whole").alias("h"))
    trees = below.groupBy("repo", "folder").agg(F.sum(F.col("h").cast("decimal(20,0)")).alias("tree"), F.sum("chars").alias("chars")).filter(f"chars >= {min_chars}")
    twice = trees.groupBy("tree").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi")).filter("lo < hi").select("tree")
    return trees.join(twice, "tree", "left_semi").select("repo", "folder")


def not_handwritten(files: DataFrame, *, min_share: float = 0.4, min_chars: int = 200) -> DataFrame:
    """(file_id, ruled, folder_shared, share) of the files that are not hand-written.

    Files with null source_code or file_id are never found; a null path has no path rule and no folder, a null repo is
    its own repository for nobody's code; repeated rows count once; an empty table gives an empty result.
    """
    looked = cut(looked_at(files))
    units = looked.select("file_id", "repo", F.explode(F.arrays_zip("digests", "sizes")).alias("u")).select("file_id", "repo", F.col("u.digests").alias("digest"), F.col("u.sizes").alias("chars")).filter("chars >= 40")
    common = units.groupBy("digest").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi")).filter("lo < hi").select("digest", F.lit(1).alias("common"))
    shares = units.join(common, "digest", "left").groupBy("file_id").agg((F.sum(F.when(F.col("common") == 1, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("share"), F.sum("chars").alias("chars"))
    shares = shares.filter(f"chars >= {min_chars} and share >= {min_share}").select("file_id", "share")
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = looked.filter("path like '%/%'").select("file_id", "repo", F.explode(folders).alias("folder"))
    foldered = under.join(shared_folders(looked, min_chars=min_chars), ["repo", "folder"], "left_semi").select("file_id").distinct()
    ruled = looked.filter("ruled").select("file_id", F.lit(True).alias("ruled"), F.lit(False).alias("folder_shared"), F.lit(0.0).alias("share"))
    rest = foldered.select("file_id", F.lit(False), F.lit(True), F.lit(0.0)).union(shares.select("file_id", F.lit(False), F.lit(False), "share"))
    return ruled.union(rest).groupBy("file_id").agg(F.max("ruled").alias("ruled"), F.max("folder_shared").alias("folder_shared"), F.max("share").alias("share"))
