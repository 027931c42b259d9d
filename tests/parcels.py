"""Parcel records, most of them sound, the rest with one or more seeded defects; what should be found follows from the seeds."""

ON_STREET, ON_LOT = "인천광역시 연수구 바다로 7", "대전광역시 유성구 들꽃동 18-2"

SCHEMA = ("record_id string, tracking_id string, sender_name string, receiver_name string, sender_phone string, "
          "receiver_phone string, address string, road_addr_yn bigint, weight_kg double, status_code string, "
          "dispatch_time string, arrival_time string, payment_method string, cod_amount double")

SOUND = 33
RANGE, FORMAT, TIME, CROSS = "out_of_range", "format_inconsistency", "temporal_violation", "cross_column_inconsistency"

#: name: (kinds of error it must raise, cells that differ from a sound record)
SEEDS = {
    "late night": ({TIME}, {"dispatch_time": "22:10:05", "arrival_time": "06:45:00"}),
    "one second": ({TIME}, {"dispatch_time": "12:00:01", "arrival_time": "12:00:00"}),
    "no sum to collect": ({CROSS}, {"payment_method": "착불", "cod_amount": 0.0}),
    "sum though prepaid": ({CROSS}, {"payment_method": "선불", "cod_amount": 120.0}),
    "sum though by card": ({CROSS}, {"payment_method": "신용카드", "cod_amount": 7.5}),
    "piano": ({RANGE}, {"weight_kg": 212.5}),
    "feather": ({RANGE}, {"weight_kg": 0.004}),
    "lightest allowed": (set(), {"weight_kg": 0.01}),
    "heaviest allowed": (set(), {"weight_kg": 30.0}),
    "no weight": (set(), {"weight_kg": None}),
    "unheard status": ({RANGE}, {"status_code": "TELEPORTED"}),
    "flag of seven": ({RANGE, CROSS}, {"road_addr_yn": 7}),
    "street as lot": ({CROSS}, {"address": ON_STREET, "road_addr_yn": 0}),
    "lot as street": ({CROSS}, {"address": ON_LOT, "road_addr_yn": 1}),
    "letters in number": ({FORMAT}, {"tracking_id": "QX77-900Z"}),
    "short number": ({FORMAT}, {"tracking_id": "907"}),
    "hour and minute": ({FORMAT}, {"dispatch_time": "09:40", "arrival_time": "17:05"}),
    "odd telephone": ({FORMAT}, {"sender_phone": "0-1-2"}),
    "to oneself": (set(), {"sender_name": "윤가람", "receiver_name": "윤가람"}),
    "everything": ({RANGE, FORMAT, TIME, CROSS}, {"tracking_id": "?", "road_addr_yn": 3, "weight_kg": 64.0, "dispatch_time": "21:00:00",
                                                  "arrival_time": "20:00:00"}),
    "without number": ({RANGE, CROSS}, {"tracking_id": None, "status_code": "LIMBO", "payment_method": "계좌이체", "cod_amount": 33.0}),
}
#: Each seed has a record number after the sound ones, with sound records between.
NUMBER = {name: SOUND + 2 * k for k, name in enumerate(SEEDS, 1)}
TOTAL = SOUND + 2 * len(SEEDS) + 4


def expected(kind):
    return sorted(NUMBER[name] for name, (kinds, _) in SEEDS.items() if kind in kinds)


def sound(i):
    collect = i % 3 == 1
    street = i % 5 < 2
    return {
        "record_id": str(i), "tracking_id": f"{7_300_000_000 + 17 * i}", "sender_name": f"from {i}", "receiver_name": f"to {i}",
        "sender_phone": f"031-{300 + i}-{7000 + i}", "receiver_phone": f"070-{4000 + i}-{5000 + i}",
        "address": ON_STREET if street else ON_LOT, "road_addr_yn": int(street), "weight_kg": 0.5 * (1 + i % 40),
        "status_code": ["DELIVERED", "PICKUP", "RETURNED", "OUT_FOR_DELIVERY", "IN_TRANSIT"][i % 5],
        "dispatch_time": f"0{i % 10}:15:00", "arrival_time": f"1{i % 10}:20:30",
        "payment_method": "착불" if collect else ["계좌이체", "선불", "신용카드"][i % 3], "cod_amount": 900.0 + i if collect else 0.0}


def records():
    seeds = {NUMBER[name]: cells for name, (_, cells) in SEEDS.items()}
    return [{**sound(i), **seeds.get(i, {})} for i in range(1, TOTAL + 1)]
