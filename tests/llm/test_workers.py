"""Worker functions must run where the package is not installed."""

import importlib
import pickle
import pkgutil
import subprocess
import sys

from pyspark import cloudpickle

from sitewright import llm

LOADER = """
import pickle, sys
sys.path = [p for p in sys.path if p not in ("", {root!r})]
failed = []
for name, payload in pickle.load(sys.stdin.buffer):
    try:
        pickle.loads(payload)
    except Exception as error:
        failed.append((name, repr(error)))
assert not any(m.split(".")[0] == "sitewright" and getattr(sys.modules[m], "__file__", None) for m in sys.modules)
print(failed)
"""


def test_worker_functions_need_no_package(tmp_path):
    payloads = []
    for info in pkgutil.iter_modules(llm.__path__):
        module = importlib.import_module(f"sitewright.llm.{info.name}")
        for name, value in vars(module).items():
            if name.endswith("_partitions") and value.__module__ == module.__name__:
                payloads.append((f"{info.name}.{name}", cloudpickle.dumps(value)))
    assert len(payloads) > 10
    root = llm.__path__[0].rsplit("/", 2)[0]
    done = subprocess.run(
        [sys.executable, "-c", LOADER.format(root=root)], input=pickle.dumps(payloads), capture_output=True, cwd=tmp_path, timeout=300
    )
    assert done.returncode == 0, done.stderr.decode()
    assert done.stdout.decode().strip() == "[]"
