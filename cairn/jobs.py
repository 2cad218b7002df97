"""Ingestion jobs: one at a time, in a thread of the driver."""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from dataclasses import dataclass, field

from .errors import Conflict, NotFound


@dataclass
class Job:
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    status: str | dict = "processing"
    progress: dict = field(default_factory=lambda: {"total": 0, "indexed": 0, "skipped": 0, "failed": 0})
    started_at: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc))
    completed_at: dt.datetime | None = None

    def to_dict(self) -> dict:
        return {"job_id": self.id, "status": self.status, "progress": dict(self.progress), "started_at": self.started_at.isoformat(), "completed_at": self.completed_at and self.completed_at.isoformat()}


class JobStore:
    def __init__(self):
        self._lock = threading.Lock()
        self._jobs: dict[str, Job] = {}
        self._last: str | None = None

    def create(self) -> Job:
        with self._lock:
            if any(j.status == "processing" for j in self._jobs.values()):
                raise Conflict("one sync job runs at a time; the last one has not ended")
            job = Job()
            self._jobs[job.id] = job
            return job

    def get(self, job_id: str) -> Job:
        with self._lock:
            if job_id not in self._jobs:
                raise NotFound(f"job not found: {job_id}")
            return self._jobs[job_id]

    def finish(self, job: Job, error: str | None = None) -> None:
        with self._lock:
            job.status = "ready" if error is None else {"failed": {"error": error}}
            job.completed_at = dt.datetime.now(dt.timezone.utc)
            if error is None:
                self._last = job.id

    def last(self) -> Job:
        with self._lock:
            if self._last is None:
                raise NotFound("no sync job has completed")
            return self._jobs[self._last]

    def run(self, work, wait: bool = False) -> Job:
        """Start ``work(job)``; its error is the job's."""
        job = self.create()

        def go():
            try:
                work(job)
            except Exception as e:
                self.finish(job, str(e))
            else:
                self.finish(job)

        if wait:
            go()
        else:
            threading.Thread(target=go, daemon=True).start()
        return job
