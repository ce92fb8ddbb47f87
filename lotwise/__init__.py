"""lotwise: price modelling on tabular listings, expressed as Spark jobs."""

import ctypes
import glob
import os
import sys


def _one_blas_thread() -> None:
    """Keep driver-side solves on one BLAS thread.

    The matrices are small, and OpenBLAS's thread pool can hang in a process that launched a JVM
    after loading it. The variable works if numpy is not loaded yet, the call if it is.
    """
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    numpy = sys.modules.get("numpy")
    if numpy is None:
        return
    site = os.path.dirname(os.path.dirname(numpy.__file__))
    for path in glob.glob(os.path.join(site, "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


_one_blas_thread()
