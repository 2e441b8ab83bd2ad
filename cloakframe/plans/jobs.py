"""Control tables: content-addressed uploads and resumable jobs, as JSON records in a folder."""

from __future__ import annotations

import csv
import glob
import os
import shutil
from datetime import UTC, datetime

from cloakframe.sources import files

STAGES = ("profile", "protect", "importance", "evidence", "audit")


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def persist_upload(folder: str, path: str) -> dict:
    """Keeps a copy of a CSV under the first 16 hex digits of its digest; the same content gives the same record."""
    files.assert_utf8(path)
    digest = files.sha256_file(path)
    home = os.path.join(folder, "uploads", digest[:16])
    record = files.read_json(os.path.join(home, "meta.json"))
    if record:
        return record
    os.makedirs(home, exist_ok=True)
    shutil.copyfile(path, os.path.join(home, "source.csv"))
    with open(path, encoding="utf-8", newline="") as f:
        rows = csv.reader(f)
        header = next(rows, [])
        record = {"id": digest[:16], "sha256": digest, "name": os.path.basename(path), "rows": sum(1 for _ in rows), "columns": header, "updatedAt": now()}
    files.write_json(os.path.join(home, "meta.json"), record)
    return record


def listed(folder: str, kind: str) -> list[dict]:
    """Records of uploads or jobs, newest first."""
    found = [files.read_json(p) for p in glob.glob(os.path.join(folder, kind, "*", "meta.json"))]
    return sorted((r for r in found if r), key=lambda r: (r.get("updatedAt", ""), r["id"]), reverse=True)


def build_job(folder: str, upload: dict, options: dict) -> dict:
    """A job known by its upload and options; one that exists is returned as it is."""
    job_id = files.stable_hash({"upload": upload["sha256"], "options": options})[:16]
    at = os.path.join(folder, "jobs", job_id, "meta.json")
    return files.read_json(at) or _save(folder, {"id": job_id, "upload": upload["id"], "options": options, "status": "queued", "done": [], "updatedAt": now()})


def _save(folder: str, job: dict) -> dict:
    files.write_json(os.path.join(folder, "jobs", job["id"], "meta.json"), job | {"updatedAt": now()})
    return job


def run_job(folder: str, job: dict, steps: dict, cancelled=lambda: False) -> dict:
    """Runs the stages that are not done yet, one record after each; a stop between stages leaves the job to be resumed."""
    job = job | {"status": "running"}
    _save(folder, job)
    for name in STAGES:
        if name not in steps or name in job["done"]:
            continue
        if cancelled():
            return _save(folder, job | {"status": "stopped"})
        try:
            steps[name]()
        except Exception as e:
            return _save(folder, job | {"status": "failed", "error": f"{name}: {e}"[:500]})
        job = job | {"done": [*job["done"], name]}
        if not cancelled():
            _save(folder, job)
    return _save(folder, job | {"status": "complete"})


def synced(folder: str, job: dict, alive: bool) -> dict:
    """What a record says after a restart: running without a process is interrupted, or complete if every stage is done."""
    if job["status"] in ("running", "stopping") and not alive:
        return _save(folder, job | {"status": "complete" if set(STAGES) <= set(job["done"]) else "interrupted"})
    return job


def latest_complete(folder: str) -> dict | None:
    return next((j for j in listed(folder, "jobs") if j["status"] == "complete"), None)


ACTIVE, RESUMABLE = ("queued", "running", "stopping"), ("created", "failed", "interrupted", "stopped")


def normal_options(given: dict) -> dict:
    """Options of a job by their own names, whatever way they are written; an id column of none, null, auto or - is no column."""
    pick = lambda *names: next((given[n] for n in names if given.get(n)), None)
    key = str(pick("id_col", "idCol") or "ID")
    return {
        "text_col": str(pick("text_col", "textCol") or "text"), "id_col": "" if key.lower() in ("none", "null", "auto", "-") else key, "label_col": str(pick("label_col", "labelCol") or "hs"),
        "model": str(pick("model", "restatementModel") or ""), "final_scrub": bool(given.get("final_scrub", given.get("finalScrub", True))), "allow_fallback": bool(given.get("allow_fallback", given.get("allowRestatementFallback", False))),
    }


def update(folder: str, job: dict, **changes) -> dict:
    return _save(folder, job | changes)


def read_job(folder: str, job_id: str) -> dict | None:
    return files.read_json(os.path.join(folder, "jobs", job_id, "meta.json"))


def decorated(job: dict, alive: bool) -> dict:
    """A record for show: whether the job runs, and whether it can be resumed."""
    return job | {"is_active": alive, "can_resume": job["status"] in RESUMABLE or job["status"] in ACTIVE and not alive}


def stop(folder: str, job_id: str, alive: bool) -> dict:
    """Asks a running job to stop at its next record; one that does not run is only brought up to date."""
    job = _known(folder, job_id)
    if not alive:
        return decorated(synced(folder, job, False), False)
    return decorated(update(folder, job, status="stopping"), True) | {"can_resume": False}


def stopping(folder: str, job_id: str) -> bool:
    """For run_job: whether a stop was asked for."""
    return (read_job(folder, job_id) or {}).get("status") == "stopping"


def resume(folder: str, job_id: str, alive: bool = False) -> dict:
    """Queues a job again with what it has done; a complete or running one stays."""
    job = synced(folder, _known(folder, job_id), alive)
    return job if job["status"] == "complete" or alive else update(folder, job, status="queued", error="")


def _known(folder: str, job_id: str) -> dict:
    job = read_job(folder, job_id)
    if job is None:
        raise ValueError(f"no such job: {job_id}")
    return job


def artifacts(job: dict, manifest: dict | None) -> dict:
    """Where a job's tables are, by its manifest: the annotated table, the audit and the token effects; null for what is not there."""
    outputs = (manifest or {}).get("outputs") or {}
    return {"job": job["id"]} | {name: outputs.get(name) for name in ("annotated", "audit", "importance", "evidence", "cases")}


def summary(folder: str, job: dict, manifest: dict | None) -> dict:
    return {"job": job, "artifacts": artifacts(job, manifest), "rows": (manifest or {}).get("rows"), "complete": job["status"] == "complete"}
