"""tessera: customer-personalisation analytics as Spark DataFrame jobs.

Every report is a function ``(DataFrames..., as_of, ...) -> DataFrame``; the
tables come from :mod:`tessera.sources`, scalar expression helpers from
:mod:`tessera.functions`, the reports and jobs from :mod:`tessera.operators`
and :mod:`tessera.plans`, and the streaming variants from
:mod:`tessera.streaming`.
"""

from tessera.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
