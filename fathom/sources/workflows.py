"""Workflow files of a CI service as rows: a table function that reads one file and gives a row for each step, with what a local run would do about it.

RUN: can be run here. SKIP: cannot, and why. PROVISION: sets up the runner, and the tool that it stands for. A file that cannot be read is one row of its own, so
that nothing is missing silently.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

try:
    import yaml
except ImportError:  # JSON files are read without it; others are reported as unreadable
    yaml = None

#: Set-up actions and the tool that each provides.
TOOLS = {
    "actions/setup-python": "python3",
    "actions/setup-node": "node",
    "actions/setup-java": "java",
    "dtolnay/rust-toolchain": "cargo",
    "gradle/actions/setup-gradle": "java",
}
#: The one name that conditions may use, and what may stand in them at all.
EVENT = "github.event_name"
TOKEN = re.compile(r"\s*(?:(&&|\|\||==|!=|!|\(|\))|'([^']*)'|\"([^\"]*)\"|([A-Za-z_][A-Za-z0-9_.-]*)|(\d+(?:\.\d+)?))")
EXPRESSION = re.compile(r"\$\{\{(.*?)\}\}", re.S)
LOCAL_TRIGGERS = ("push", "pull_request")


class Unevaluable(Exception):
    pass


def condition(text: object, event: str) -> bool | None:
    """Whether an `if` holds for an event; no condition holds; None where that cannot be told. Names other than the event's are unevaluable, but only if the answer depends on
    them; `!` binds what follows up to the next && or ||."""
    if text is None:
        return True
    words, at, source = [], 0, str(text).strip()
    if source in ("true", "false"):
        return source == "true"
    while at < len(source):
        if not (m := TOKEN.match(source, at)):
            return None
        words.append(m.groups())
        at = m.end()
    if any(w[3] and w[3].startswith("github.") for w in words) and not any(w[3] == EVENT for w in words):
        return None
    words.append((None,) * 5)
    place = 0

    def take(*signs: str) -> str | None:
        nonlocal place
        if words[place][0] in signs:
            place += 1
            return words[place - 1][0]
        return None

    def chain(sign, part):
        def read():
            parts = [part()]
            while take(sign):
                parts.append(part())
            if len(parts) == 1:
                return parts[0]
            stop = sign == "||"

            def value():
                for p in parts:
                    if bool(v := p()) == stop:
                        return v
                return v

            return value

        return read

    def negation():
        if take("!"):
            inner = negation()
            return lambda: not inner()
        return comparison()

    def comparison():
        left = atom()
        if sign := take("==", "!="):
            right, compare = atom(), operator.eq if sign == "==" else operator.ne
            return lambda: compare(left(), right())
        return left

    def atom():
        nonlocal place
        if take("("):
            inner = either()
            if not take(")"):
                raise Unevaluable
            return inner
        sign, single, double, name, number = words[place]
        if sign or words[place] == (None,) * 5:
            raise Unevaluable
        place += 1
        if name == EVENT:
            return lambda: event
        if name:

            def unknown():
                raise Unevaluable

            return unknown
        return lambda: float(number) if number else single if single is not None else double

    either = chain("||", chain("&&", negation))
    try:
        value = either()
        if place != len(words) - 1:
            return None
        return bool(value())
    except Unevaluable:
        return None


def document(text: str) -> dict:
    """The mapping in a workflow file; ValueError if there is none."""
    try:
        found = json.loads(text)
    except ValueError:
        if yaml is None:
            raise ValueError("no reader for this file") from None
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(type(e).__name__) from None
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError("not a mapping")
    return found


def _part(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _texts(*layers: object) -> dict[str, str]:
    """Later layers win; null is an empty text."""
    return {str(k): "" if v is None else str(v) for layer in layers for k, v in _part(layer).items()}


def _system(runs_on: str) -> str:
    return next((system for name, system in (("macos", "darwin"), ("windows", "windows")) if name in runs_on), "linux")


def _job_state(flow: dict, job: dict, runs_on: str, event: str, system: str) -> tuple[str | None, str | None]:
    """(why no step of the job runs here, a remark on those that do)."""
    on = flow.get("on", flow.get(True)) or {}
    names = [on] if isinstance(on, str) else [str(x) for x in on]
    if not any(n in LOCAL_TRIGGERS for n in names):
        return f"not triggered by a push or pull request ({', '.join(sorted(names)) or 'no triggers'})", None
    holds = condition(job.get("if"), event)
    if holds is None:
        return f"job condition cannot be evaluated: {job.get('if')}", None
    if not holds:
        return f"job condition is false: {job.get('if')}", None
    wanted = _system(runs_on)
    if wanted != system:
        return ("needs windows", None) if wanted == "windows" else (None, f"meant for {wanted}")
    return None, None


def _step_reason(step: dict, script: str, env: dict[str, str], event: str) -> str | None:
    holds = condition(step.get("if"), event)
    if holds is None:
        return f"step condition cannot be evaluated: {step.get('if')}"
    if not holds:
        return f"step condition is false: {step.get('if')}"
    texts = [script, *env.values()]
    if any("secrets." in t for t in texts):
        return "needs a secret"
    open_ = [e.strip() for t in texts for e in EXPRESSION.findall(t) if not e.strip().startswith("github.workspace")]
    return f"uses an expression of the service: {open_[0]}" if open_ else None


STEP = "job string, runs_on string, workflow string, ordinal int, step string, status string, reason string, tool string, directory string, shell string, env map<string,string>, script string"


def steps(text: str, name: str, event: str, system: str) -> Iterator[tuple]:
    try:
        flow = document(text or "")
    except ValueError as e:
        yield (None, None, name, 0, None, "SKIP", f"cannot be read: {e}", None, None, None, None, None)
        return
    title = str(flow.get("name", name))
    folder = _part(_part(flow.get("defaults")).get("run")).get("working-directory")
    for job_id, job in _part(flow.get("jobs")).items():
        job = _part(job)
        on = job.get("runs-on") or ""
        runs_on = " ".join(map(str, on)) if isinstance(on, list) else str(on)
        skipped, remark = _job_state(flow, job, runs_on, event, system)
        home = _part(_part(job.get("defaults")).get("run")).get("working-directory", folder)
        for i, step in enumerate(job.get("steps") or []):
            step = _part(step)
            head = (str(job_id), runs_on, title, i, str(step.get("name") or step.get("uses") or f"step {i + 1}"))
            env, script = _texts(flow.get("env"), job.get("env"), step.get("env")), step.get("run")
            at = (step.get("working-directory", home) or "", "bash" if step.get("shell") == "bash" else "default")
            if "uses" in step:
                tool = TOOLS.get(str(step["uses"]).split("@")[0])
                yield (*head, "PROVISION", f"sets up {tool}" if tool else "sets up the runner", tool, None, None, None, None)
            elif script is None:
                yield (*head, "SKIP", "neither runs nor uses anything", None, *at, None, None)
            else:
                reason = skipped or _step_reason(step, str(script), env, event)
                yield (*head, "SKIP" if reason else "RUN", reason or remark, None, *at, env, str(script))


@udtf(returnType=STEP)
class WorkflowSteps:
    def eval(self, text: str, name: str, event: str, system: str):
        yield from steps(text, name, event, system)


def workflow_steps(files: DataFrame, event: str = "push", system: str = "linux") -> DataFrame:
    """files (path, value: the text) -> one row for each step, with its file. Null texts are empty files, which have no steps."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.select("path", F.coalesce("value", F.lit("")).alias("value"), name.alias("_name"))
    return rows.lateralJoin(WorkflowSteps(F.col("value").outer(), F.col("_name").outer(), F.lit(event), F.lit(system))).drop("value", "_name")


@udtf(returnType="name string, parsed boolean, has_push boolean, paths array<string>, tags array<string>, branches array<string>, paths_ignore array<string>")
class WorkflowTriggers:
    def eval(self, text: str, name: str):
        try:
            flow = document(text or "")
        except ValueError:
            yield (name, False, False, [], [], [], [])
            return
        on = flow.get("on", flow.get(True)) or {}
        push = _part(on.get("push")) if isinstance(on, dict) else {}

        def listed(key: str) -> list[str]:
            value = push.get(key) or []
            return [str(x) for x in (value if isinstance(value, list) else [value])]

        has = on == "push" if isinstance(on, str) else "push" in on
        yield (str(flow.get("name", name)), True, has, listed("paths"), listed("tags"), listed("branches"), listed("paths-ignore"))


def workflow_triggers(files: DataFrame) -> DataFrame:
    """files (path, value) -> what registers.workflow_required() takes, with the path. A file that cannot be read is not parsed, and so required."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.select("path", F.coalesce("value", F.lit("")).alias("value"), name.alias("_name"))
    return rows.lateralJoin(WorkflowTriggers(F.col("value").outer(), F.col("_name").outer())).drop("value", "_name")
