"""Detectors together: the same findings as one by one, from packets and channels that are written once."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from flowquarry.operators import behavior as B
from flowquarry.operators import detect
from flowquarry.plans.queries import Capture

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")
def test_packets_are_projected_once_for_all_detectors(spark):
    c = Capture(spark, SF)
    found = detect.all_findings(c.packets, c.flows, c.contacts)
    assert not [f for f in found.inputFiles() if "events" in f]
    packets = [d(c.packets) for d in (detect.arp_spoofing, detect.tool_agents, detect.disguised_downloads, detect.cryptomining, detect.credentials, detect.personal_data, detect.dns_tunnels, detect.generated_domains, detect.icmp_tunnels, detect.industrial_writes)]
    channels = [d(B.channels(c.contacts)) for d in (detect.beacons, detect.exfiltration, detect.brute_force, detect.lateral_movement, detect.exposed_access)]
    got = [str(r) for r in found.collect()]
    for alone in (*packets, *channels):
        rows = [str(r) for r in alone.collect()]
        assert all(got.count(r) == rows.count(r) for r in rows)
