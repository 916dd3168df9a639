"""Times registered queries against a no-op sink, warm. usage: python tools/profile.py [folder] name ..."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from duskboard.plans.registry import queries  # noqa: E402
from duskboard.session import local_session  # noqa: E402

folder, names = sys.argv[1], sys.argv[2:]
spark = local_session()
spark.range(1000).groupBy("id").count().collect()
for name, fn in queries().items():
    if names and name not in names:
        continue
    times = []
    for _ in range(2):
        start = time.time()
        fn(spark, folder).write.format("noop").mode("overwrite").save()
        times.append(round(time.time() - start, 2))
    print(name, times, flush=True)
