"""Sample texts of one invented incident each: a warehouse robot fleet, and a clinic's booking desk."""

import json

FLEET = ("picker", "lifter", "sorter")


def _analysis() -> list[str]:
    lines = ["Robot fleet report, night shift"]
    # The database fills its disk first, everything else follows from that.
    lines += ["2026-11-03T02:10:00.000Z 9 [ERROR] [MY-44] [Server] no space left on device while writing page 811"]
    lines += ["2026-11-03 02:10:01 UTC [501] FATAL:  could not extend file", "HINT:  Check free disk space.", "2026-11-03 02:10:02 UTC [502] ERROR:  duplicate key value"]
    lines += [f"2026-11-03 02:10:0{3 + k},250 ERROR [{robot}] w.r.Arm - IndexOutOfBounds in slot {4000 + k}\n\tat w.r.Arm.grab(Arm.java:1{k})\nCaused by: w.r.Lost: bin" for k, robot in enumerate(FLEET)]
    lines += [f"<11>1 2026-11-03T02:10:1{k}Z dock{k} conveyor 77 J{k} - panic: belt index 1{k}00 out of reach" for k in range(4)]
    lines += [f"level=warn service=charger msg=\"battery low\" robot={robot}" for robot in FLEET]
    lines += ["Nov  3 02:10:20 dock-2 chronyd[55]: NTP source unreachable, network is unreachable"]
    lines += [json.dumps({"log": f"level=critical app=router msg=\"x509: issuer unknown for robot{k}.fleet.example\"\n", "stream": "stdout", "time": f"2026-11-03T02:10:3{k}Z"}) for k in range(2)]
    lines += ['192.0.2.15 - - [03/Nov/2026:02:10:40 +0000] "GET /robots/550011 HTTP/1.1" 200 7 "-" "panel"', '192.0.2.15 - - [03/Nov/2026:02:10:41 +0000] "PUT /robots/550012 HTTP/1.1" 503 0 "-" "panel"']
    lines += ["2026-11-03T02:10:50Z stdout F all arms parked"]
    return lines


ANALYSIS = "\n".join(_analysis())

SECRETS = "\n".join(
    [
        "Desk notes for Tuesday",
        "patient called from +1 (202) 555-0147, host=198.51.100.20",
        json.dumps({"desk": 3, "contact": ["mara@clinic.example", {"password": "tulip-9"}], "seen": True}),
        "session_id=walk-in-1 desk=3",
        "Set-Cookie: visit=7; path=/",
        "mail mara@clinic.example or teo@clinic.example",
        "Authorization: Bearer q1.w2",
        "card 5555 5555 5555 4444 accepted, 5555555555554445 refused",
        "",
        "token=blue-41 client_ip=198.51.100.20",
    ]
)
