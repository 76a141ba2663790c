"""Settings of a worker: made from any mapping of names to text, by the types of the fields, and checked once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import MISSING, dataclass, field, fields, replace

#: What a setting may say for yes.
YES = frozenset(("1", "true", "yes", "y", "on"))
TEXT_TO = {"str": str, "int": int, "bool": lambda text: text.lower() in YES}


def setting(default=MISSING, *names: str):
    """A field that may go by other names too; without a default it must be given."""
    return field(default=default, metadata={"names": names})


def from_text(kind: type, source: Mapping[str, str] | None = None, prefix: str = "", **given):
    """kind(...) of what is given, else of source (the environment): PREFIX + FIELD, then the field's other names. Blank is unset."""
    source = os.environ if source is None else source
    values, lost = {k: v for k, v in given.items() if v is not None}, []
    for f in fields(kind):
        names = (f"{prefix}{f.name}".upper(), *f.metadata.get("names", ()))
        text = next((t for t in (source.get(n, "").strip() for n in names) if t), None)
        if f.name in values:
            continue
        if text is not None:
            values[f.name] = TEXT_TO[f.type](text)
        elif f.default is MISSING:
            lost.append(names[0])
    if lost:
        raise ValueError(f"not set: {', '.join(lost)}")
    return kind(**values)


@dataclass(frozen=True)
class WorkerConfig:
    """A worker of a run. Its shard is told by itself, or by the variable that a scheduler sets for the jobs of an array."""

    run_id: str = ""
    worker_id: str = ""
    shards: int = setting(1, "NUM_SHARDS")
    shard: int = setting(0, "SHARD_INDEX", "AWS_BATCH_JOB_ARRAY_INDEX", "SLURM_ARRAY_TASK_ID")
    most_frames: int = 8
    lease_seconds: int = 7200
    max_attempts: int = 3
    shared_state: bool = False
    force: bool = False
    output: str = "out"

    def checked(self) -> WorkerConfig:
        if self.shards < 1 or not 0 <= self.shard < self.shards:
            raise ValueError(f"shard {self.shard} of {self.shards}")
        if min(self.most_frames, self.lease_seconds, self.max_attempts) < 1:
            raise ValueError("frames, lease and attempts must be 1 at least")
        if self.shared_state and self.force:
            raise ValueError("shared state forbids doing clips again by force")
        if self.shared_state and not self.run_id:
            raise ValueError("shared state needs a run")
        return replace(self, worker_id=self.worker_id or f"{self.run_id or 'local'}-shard-{self.shard}-of-{self.shards}")

    def output_path(self) -> str:
        return f"{self.output.rstrip('/')}/worker_{self.shard}_of_{self.shards}.jsonl"
