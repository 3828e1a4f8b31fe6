"""Fixed values of the message protocol and of the calendar, kept as they appear in the data."""

# The seven comma-separated payload fields, in payload order.
PAYLOAD_FIELDS = ("device_type", "detector", "battery", "fault", "rssi", "snr", "action")
NUMERIC_FIELDS = ("battery", "fault", "rssi", "snr")  # blank means missing
TYPED_FIELDS = ("battery", "rssi", "snr")  # the fault is compared as text

# A field label and its separator, e.g. "검지기: ". The class holds no colon, so a
# possessive quantifier matches the same and never backtracks.
LABEL_PATTERN = r"[a-zA-Z|가-힣\s]++: "

# Words around the site in a sensor name, and the characters both are made of.
DEVICE_PREFIX, REST_AREA = "주차센서_", "졸음쉼터"
NAME_CHARACTERS = "주차센서_|졸음쉼터"

# Detector states as sent, and after dropping the "차량" prefix.
PARK, DEPART, BOOT = "차량주차", "차량출차", "초기부팅"
PARK_SHORT, DEPART_SHORT = "주차", "출차"

# Actions as sent.
EVENT, PERIODIC, BOOT_ACTION = "주차이벤트", "주기보고", "초기 부팅"
FAULT_RESET, FAULT_RESET_LABEL = "51.0", "리셋 발생"
LORA_RESET_CODES, LORA_RESET = ("2.0", "오류"), "LoRa Reset 수신 후 부팅"
LORA_SELF_RESET_CODE, LORA_SELF_RESET = "3.0", "LoRa 전송오류 등으로 인한 자체 시스템 Reset"

# Action categories.
COMM_CODES = ("오류", "2.0", "3.0")
COMM_ERROR, SENSOR_ERROR, NORMAL = "통신오류", "센서오류", "정상"

# Labels of the status codes 0 to 3.
STATUS_LABELS = {0: "정상", 1: "주기보고", 2: "통신 및 기기 오류", 3: "중복이벤트"}

# Status codes.
OK, REPORT, DEVICE_ERROR, SEQUENCE_ERROR, AFTER_REPORT = 0, 1, 2, 3, 4

# Public holidays of 2022 and the bounds of the lunar new year window.
HOLIDAYS = (
    "2022-01-01", "2022-01-31", "2022-02-01", "2022-02-02", "2022-03-01", "2022-05-05",
    "2022-05-08", "2022-06-06", "2022-08-15", "2022-09-09", "2022-09-10", "2022-09-11",
    "2022-09-12", "2022-10-03", "2022-10-09", "2022-10-10", "2022-12-25",
)
NEW_YEAR_WINDOW = ("2022-01-28", "2022-02-02")

# Day type and day/night labels.
LUNAR_NEW_YEAR, HOLIDAY, WORKDAY = "설연휴", "휴일", "평일"
DAY, NIGHT = "낮", "밤"

# Weekday names, Monday first.
WEEKDAY_NAMES = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)
