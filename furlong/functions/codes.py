"""Code tables and the broadcast decode join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions.constants import constant_rows

# Labels the record parsers write.
VENUE = {"01": "札幌", "02": "函館", "03": "福島", "04": "新潟", "05": "東京",
         "06": "中山", "07": "中京", "08": "京都", "09": "阪神", "10": "小倉"}
SURFACE = {"1": "turf", "2": "dirt", "3": "obstacle"}
SEX = {"1": "牡", "2": "牝", "3": "セン"}
GOING = {"10": "良", "11": "速良", "12": "遅良", "20": "稍重", "21": "速稍重", "22": "遅稍重",
         "30": "重", "31": "速重", "32": "遅重", "40": "不良", "41": "速不良", "42": "遅不良",
         "1": "良", "2": "稍重", "3": "重", "4": "不良"}
WEATHER = {"1": "晴", "2": "曇", "3": "小雨", "4": "雨", "5": "小雪", "6": "雪"}

# The published code tables, one line per table, "code label" pairs.
CODE_TABLES = {
    "running_style": "1 逃げ,2 先行,3 差し,4 追込,5 好位差し,6 自在",
    "distance_aptitude": "1 短距離,2 中距離,3 長距離,5 マイル,6 万能",
    "improvement": "1 AA,2 A,3 B,4 C,5 ?",
    "training_arrow": "1 デキ抜群,2 上昇,3 平行線,4 やや下降気味,5 デキ落ち",
    "stable_rating": "1 超強気,2 強気,3 現状維持,4 弱気",
    "hoof": "01 大ベタ,06 中立,10 中標準",
    "heavy_aptitude": "1 ◎,2 ○,3 △",
    "venue": "01 札幌,02 函館,03 福島,04 新潟,05 東京,06 中山,07 中京,08 京都,09 阪神,10 小倉,"
             "21 旭川,22 札幌(地方),23 門別,24 北見,25 岩見沢,26 帯広,30 盛岡,31 水沢,32 上山,33 三条,"
             "34 足利,35 宇都宮,36 高崎,37 浦和,38 船橋,39 大井,40 川崎,41 金沢,42 笠松,43 名古屋,"
             "44 紀三井寺,45 園田,46 姫路,47 益田,48 福山,49 高知,50 佐賀,51 荒尾,52 中津,"
             "61 英国,62 愛国,63 仏国,64 伊国,65 独国,66 米国,67 カナダ,68 UAE,69 豪州,"
             "70 ニュージーランド,71 香港,72 チリ,73 シンガポール,74 スウェーデン,75 マカオ,"
             "76 オーストリア,77 トルコ,78 カタール,79 韓国",
    "going": "10 良,11 速良,12 遅良,20 稍重,21 速稍重,22 遅稍重,30 重,31 速重,32 遅重,"
             "40 不良,41 速不良,42 遅不良",
    "age_type": "11 2歳,12 3歳,13 3歳以上,14 4歳以上,20 障害,99 その他",
    # Code 16 is published twice (2勝クラス and 3勝クラス); the first entry is kept.
    "condition": "A1 新馬,A2 未出走,A3 未勝利,04 1勝クラス,05 1勝クラス,10 2勝クラス,16 2勝クラス,"
                 "15 3勝クラス,OP オープン",
    "weight_type": "1 ハンデ,2 別定,3 馬齢,4 定量",
    "grade": "1 G1,2 G2,3 G3,4 重賞（非G）,5 特別,6 リステッド",
    "abnormality": "0 正常,1 取消,2 除外,3 中止,4 失格,5 降着,6 再騎乗",
    "mark": "1 ◎,2 ○,3 ▲,4 注,5 △,6 △,9 ☆",
    "coat": "01 栗毛,02 栃栗毛,03 鹿毛,04 黒鹿毛,05 青鹿毛,06 青毛,07 芦毛,08 栗粕毛,09 鹿粕毛,"
            "10 青粕毛,11 白毛",
    "weather": "1 晴,2 曇,3 小雨,4 雨,5 小雪,6 雪",
    "tack": "001 ブリンカー,002 シャドーロール,007 バンテージ,008 メンコ,045 ソエ焼く,089 皮膚病",
    "leg": "000 バンテージ腕節まで,001 蹄汚い,002 球節腫れる,010 バンテージ巻く,047 飛節焼き治療,"
           "100 歩様悪,115 膝が震える,120 肩の出窮屈",
    "remark": "033 口向き悪い,034 放馬,040 心房細動,041 喉鳴り,042 熱発,043 鼻出血,044 ソエ,049 気悪,"
              "050 素直,051 根性有り,063 ダ重い○,064 ダ重い×,069 芝重い○,070 芝重い×,087 大トビ,"
              "410 本格化,449 ペース速○,450 ペース速×,771 ブリンカー必要",
    "sire_line": "11 ノーザンダンサー系,12 ロイヤルチャージャー系,13 ナスルーラ系,14 ネアルコ系,"
                 "15 ネイティヴダンサー系,16 フェアウェイ系,17 ダマスカス系,18 ハイペリオン系,"
                 "19 エクリプス系,20 セントサイモン系,1101 ノーザンダンサー,1102 ニジンスキー,"
                 "1109 サドラーズウェルズ",
    "work_state": "01 流す,02 余力あり,03 終い抑え,04 一杯,05 バテる,06 伸びる,07 テンのみ,08 鋭く伸び,"
                  "09 強目,21 引っ張る,22 掛かる,24 テン掛る,99 その他",
    "work_course": "01 美浦坂路,02 南W,03 南D,04 南芝,05 南A,10 ポリトラック,11 栗東坂路,12 CW,13 DW,14 B,"
                   "15 E,16 栗芝,17 栗P,18 障害,19 プール,50 地方競馬,61 障害試験,88 牧場,A1 連闘,B1 その他",
}
# Grade steps of the class table, filled in by class_table().
FLAT_CLASSES = ("OP", "3勝クラス", "2勝クラス", "1勝クラス", "未勝利")
JUMP_CLASSES = ("OP", "1勝クラス", "未勝利")


def class_table() -> dict[str, str]:
    """Class codes: G1-G3, then each class as an A/B/C triple, per surface."""
    table = {}
    for start, prefix, steps in ((1, "芝", FLAT_CLASSES), (21, "ダート", FLAT_CLASSES), (51, "障害", JUMP_CLASSES)):
        labels = ["G1", "G2", "G3"] + [f"{step}{sub}" for step in steps for sub in "ABC"]
        table.update({f"{start + i:02d}": prefix + label for i, label in enumerate(labels)})
    return table


def code_rows() -> list[tuple[str, str, str]]:
    rows = [(table, *entry.split(" ", 1))
            for table, entries in CODE_TABLES.items() for entry in entries.split(",")]
    return rows + [("class", code, label) for code, label in class_table().items()]


def code_dimension(spark: SparkSession) -> DataFrame:
    """All tables as one long dimension (code_table, code, label)."""
    return constant_rows(spark, code_rows(), "code_table string, code string, label string")


def decode_codes(df: DataFrame, columns: dict[str, str], suffix: str = "_label") -> DataFrame:
    """Add a label next to each code column, through joins with the fixed dimension.

    The dimension holds a few hundred rows whatever the data size, so it is
    always safe to broadcast.
    """
    dimension = code_dimension(df.sparkSession)
    for column, table in columns.items():
        side = dimension.where(F.col("code_table") == table).select(
            F.col("code").alias(f"_{column}"), F.col("label").alias(column + suffix))
        df = df.join(F.broadcast(side), F.col(column).cast("string") == F.col(f"_{column}"), "left") \
            .drop(f"_{column}")
    return df
