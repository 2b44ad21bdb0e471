"""Whole files through the bundled grammars.

Scripts are cut into terminals by ``granary.scripts.lexer`` and run through LALR(1) tables to the end; the first token for
which the tables have no action, and before which no statement end may be put in, is the error.  All files of a batch are
parsed side by side: one step of every file at a time, as array operations over states, stacks and tokens.
"""

from __future__ import annotations

import json
import re

import numpy as np

from granary.scripts.grammar import Tables, tables
from granary.scripts.lexer import Lexer

# Extension -> (typed, with elements).
SCRIPTS = {"js": (False, False), "mjs": (False, False), "jsx": (False, True), "ts": (True, False), "tsx": (True, True), "vue": (False, False), "svelte": (False, False)}

_SCRIPT = re.compile(r"<script\b[^>]*>([\s\S]*?)(?:</script\s*>|\Z)", re.I)


def extension(path: str) -> str:
    name, dot, ext = path.rpartition("/")[2].rpartition(".")
    return ext.lower() if dot else ""


def blocks(text: str, ext: str) -> list[tuple[str, int]]:
    """The scripts of a file with their offsets: the script blocks of a component, else the whole text."""
    if ext in ("vue", "svelte"):
        text_or_comment = re.sub(r"<!--[\s\S]*?-->", lambda m: " " * len(m[0]) if "<script" not in m[0] else m[0], text)
        return [(m[1], m.start(1)) for m in _SCRIPT.finditer(text_or_comment)]
    return [(text, 0)]


def _reject_constant(name: str) -> None:
    raise ValueError(name)


def json_error(text: str) -> int | None:
    """Offset of the first error of strict JSON."""
    try:
        json.loads(text, parse_constant=_reject_constant)
    except json.JSONDecodeError as e:
        return e.pos
    except (ValueError, RecursionError):
        return 0
    return None


#: below so many files side by side, one at a time is faster
_FEW = 24
#: entries of a stack that grows side by side with others
_DEEP = 2048


def _one(table: Tables, lists: dict, token: list[int], may_end: list[bool], pos: int, stack: list[int], waiting: bool) -> int:
    """Goes on with one file from any state of ``parse_all``; place of the error or -1."""
    if not lists:
        lists.update(action=table.action.tolist(), goto=table.goto.tolist(), length=table.rule_length.tolist(), left=table.rule_left.tolist())
    action, goto, length, left, asi = lists["action"], lists["goto"], lists["length"], lists["left"], table.terminals["ASI"]
    while True:
        act = action[stack[-1]][asi if waiting else token[pos]]
        if act > 0:
            stack.append(act - 1)
            if waiting:
                waiting = False
            else:
                pos += 1
        elif act == Tables.ACCEPT:
            return -1
        elif act < 0:
            if length[-act]:
                del stack[-length[-act] :]
            stack.append(goto[stack[-1]][left[-act]])
        elif waiting or not may_end[pos]:
            return pos
        else:
            waiting = True


def parse_all(lexed: list[Lexer], table: Tables) -> np.ndarray:
    """For each token list the index of the first token that can't stand where it does, or -1."""
    n = len(lexed)
    error = np.full(n, -1, np.int64)
    if not n:
        return error
    number = table.terminals
    lengths = np.array([len(x.tokens) for x in lexed])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    unknown = number["ERR"]
    token = np.concatenate([np.array([number.get(t, unknown) for t in x.tokens], np.int32) for x in lexed])
    line = np.concatenate([np.array(x.line_before, bool) for x in lexed])
    may_end = line | (token == number["}"]) | (token == number["EOF"])
    asi, action, goto = number["ASI"], table.action, table.goto
    lists: dict = {}
    # files of similar length side by side
    for group in np.array_split(np.argsort(lengths, kind="stable"), max(1, n // 4000)):
        live = group
        pos, top = begin[live].copy(), np.zeros(len(live), np.int64)
        stack = np.zeros((len(live), 256), np.int16)
        waiting = np.zeros(len(live), bool)  # a statement end was put in and isn't read yet
        if len(live) <= _FEW:
            for i in live.tolist():
                a, b = int(begin[i]), int(begin[i] + lengths[i])
                error[i] = _one(table, lists, token[a:b].tolist(), may_end[a:b].tolist(), 0, [0], False)
            continue
        while len(live):
            for _ in range(64):
                row = np.arange(len(live))
                state = stack[row, top]
                act = action[state, np.where(waiting, asi, token[pos])].astype(np.int32)
                stuck = (act == 0) & ~waiting & may_end[pos]
                if stuck.any():
                    waiting |= stuck
                    act = np.where(stuck, action[state, asi], act).astype(np.int32)
                shift = (act > 0).nonzero()[0]
                reduce = ((act < 0) & (act != Tables.ACCEPT)).nonzero()[0]
                done = (act == 0) | (act == Tables.ACCEPT)
                if len(reduce):
                    rule = -act[reduce]
                    top[reduce] -= table.rule_length[rule]
                    state = goto[stack[reduce, top[reduce]], table.rule_left[rule]]
                    top[reduce] += 1
                    stack[reduce, top[reduce]] = state
                if len(shift):
                    top[shift] += 1
                    stack[shift, top[shift]] = act[shift] - 1
                    pos[shift] += ~waiting[shift]
                    waiting[shift] = False
                if done.any():
                    failed = act == 0
                    error[live[failed]] = pos[failed] - begin[live[failed]]
                    keep = ~done
                    live, pos, top, stack, waiting = live[keep], pos[keep], top[keep], stack[keep], waiting[keep]
                # few files left, or one nested so deeply that the others' stacks would grow with its own
                full = top + 2 > stack.shape[1]
                alone = np.ones(len(live), bool) if len(live) <= _FEW else full & (stack.shape[1] >= _DEEP)
                if alone.any():
                    for k in alone.nonzero()[0].tolist():
                        a, b = int(begin[live[k]]), int(begin[live[k]] + lengths[live[k]])
                        error[live[k]] = _one(table, lists, token[a:b].tolist(), may_end[a:b].tolist(), int(pos[k]) - a, stack[k, : top[k] + 1].tolist(), bool(waiting[k]))
                    live, pos, top, stack, waiting = live[~alone], pos[~alone], top[~alone], stack[~alone], waiting[~alone]
                    if not len(live):
                        break
                elif full.any():
                    stack = np.concatenate([stack, np.zeros_like(stack)], axis=1)
    return error


def errors(paths: list[str | None], texts: list[str]) -> list[int | None]:
    """For each file the line of its first error, or None."""
    out: list[int | None] = [None] * len(paths)
    jobs: dict[bool, list[tuple[int, int, Lexer]]] = {False: [], True: []}
    for i, (path, text) in enumerate(zip(paths, texts, strict=True)):
        ext = extension(path or "")
        if ext == "json":
            at = json_error(text)
            out[i] = None if at is None else text.count("\n", 0, at) + 1
        elif ext in SCRIPTS:
            typed, elements = SCRIPTS[ext]
            jobs[typed] += [(i, offset, Lexer(script, typed, elements)) for script, offset in blocks(text, ext)]
    for typed, mine in jobs.items():
        for (i, offset, lexed), bad in zip(mine, parse_all([x for *_, x in mine], tables(typed)), strict=True):
            if bad >= 0:
                line = texts[i].count("\n", 0, offset + lexed.starts[bad]) + 1
                out[i] = line if out[i] is None else min(out[i], line)
    return out
