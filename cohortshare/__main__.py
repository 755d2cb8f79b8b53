"""``python -m cohortshare <job> ...`` (same as ``python -m cohortshare.cli``)."""

from .cli import main

raise SystemExit(main())
