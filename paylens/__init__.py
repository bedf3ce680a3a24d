"""paylens: Spark-native analytics over public research-payment disclosures.

Everything is expressed with DataFrame / SQL built-ins so that Catalyst plans a
single scan per report, whatever the number of names asked about.
"""

from paylens.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
